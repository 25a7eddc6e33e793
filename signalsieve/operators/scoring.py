"""Rule-based scoring: one select of built-in expressions, staged so that every
expensive intermediate is computed once per row and no generated method grows large."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalsieve.functions import fixed_values as fv
from signalsieve.functions.fixed_values import DEFAULT_RULES, RuleBook
from signalsieve.functions.keywords import KeywordIndex
from signalsieve.functions.matching import any_contains
from signalsieve.functions.numbers import max_records, records_score
from signalsieve.functions.phrases import ENGLISH, REASONING_COMBO, REASONING_RULES, REASONING_VENDOR, Phrases, fill
from signalsieve.functions.reuse import reuse
from signalsieve.functions.text import text_or_empty
from signalsieve.operators.settle import settle


def scoring_text(title: Column, body: Column) -> Column:
    """The text every rule looks at."""
    return F.lower(F.concat(text_or_empty(title), F.lit(" "), text_or_empty(body)))


def rule_keywords(rules: RuleBook = DEFAULT_RULES) -> KeywordIndex:
    """Every keyword that is looked for in the text, found in one pass."""
    return reuse("text keywords", (rules,), lambda: _text_index(rules))


def _text_index(rules: RuleBook) -> KeywordIndex:
    return KeywordIndex(
        rules.vendor_patterns, *rules.data_types.values(), rules.fresh_positive, rules.fresh_negative,
        rules.ransom_sites, fv.COMBO_WORDS, fv.DATABASE_WORDS, fv.ACCESS_WORDS, fv.DISCUSSION_WORDS,
    )


def vendor_match(hits: Column, rules: RuleBook = DEFAULT_RULES) -> Column:
    """First vendor pattern in the text, null when none."""
    return rule_keywords(rules).first(hits, [(w, w) for w in rules.vendor_patterns])


def data_types(hits: Column, rules: RuleBook = DEFAULT_RULES) -> Column:
    """Names of the data types seen in the text, sorted."""
    return rule_keywords(rules).groups(hits, rules.data_types)


def _has(types: Column, *names: str) -> Column:
    return reduce(lambda a, b: a | b, (F.array_contains(types, n) for n in names))


def is_combo(types: Column) -> Column:
    """The text is an aggregate."""
    return _has(types, "combo")


def combo_score(base: Column) -> Column:
    return F.least(base, F.lit(fv.COMBO_MAX_SCORE))


def type_boost(types: Column) -> Column:
    """Points for sensitive data types, at most three."""
    def points(hit: Column, n: int) -> Column:
        return F.when(hit, n).otherwise(0)

    total = (
        points(_has(types, "email") & _has(types, "password"), 2)
        + points(_has(types, "credit_card", "financial"), 2)
        + points(_has(types, "medical", "government"), 2)
        + points(_has(types, "ssn", "dob"), 1)
        + points(_has(types, "cookie"), 1)
    )
    return F.least(total, F.lit(fv.MAX_TYPE_BOOST))


def fresh_positive(hits: Column, rules: RuleBook = DEFAULT_RULES) -> Column:
    return rule_keywords(rules).any(hits, rules.fresh_positive)


def fresh_negative(hits: Column, rules: RuleBook = DEFAULT_RULES) -> Column:
    return rule_keywords(rules).any(hits, rules.fresh_negative)


def freshness_boost(pos: Column, neg: Column) -> Column:
    """A stale sign outweighs a fresh one."""
    return F.when(neg, -2).when(pos, 1).otherwise(0)


def in_tier1(site: Column, rules: RuleBook = DEFAULT_RULES) -> Column:
    return any_contains(site, rules.tier1_sites)


def in_tier2(site: Column, rules: RuleBook = DEFAULT_RULES) -> Column:
    return any_contains(site, rules.tier2_sites)


def in_ransom(site: Column, rules: RuleBook = DEFAULT_RULES) -> Column:
    return any_contains(site, rules.ransom_sites)


def site_boost(tier1: Column) -> Column:
    """One point for a first-tier site."""
    return F.when(tier1, 1).otherwise(0)


def category(hits: Column, types: Column, site: Column, rules: RuleBook = DEFAULT_RULES) -> Column:
    """Ordered decision list."""
    index = rule_keywords(rules)
    return (
        F.when(_has(types, "combo") | index.any(hits, fv.COMBO_WORDS), "credential_leak")
        .when(index.any(hits, fv.DATABASE_WORDS), "database_dump")
        .when(_has(types, "credit_card", "financial"), "financial_data")
        .when(_has(types, "medical"), "personal_info")
        .when(_has(types, "government"), "database_dump")
        .when(_has(types, "source_code"), "other")
        .when(index.any(hits, fv.ACCESS_WORDS), "access_sale")
        .when(_has(types, "email", "password"), "credential_leak")
        .when(F.size(types) > 0, "database_dump")
        .when(index.any(hits, rules.ransom_sites) | any_contains(site, rules.ransom_sites), "database_dump")
        .when(index.any(hits, fv.DISCUSSION_WORDS), "general_discussion")
        .otherwise("other")
    )


def final_score(base: Column, *boosts: Column) -> Column:
    """Sum clamped to 1..10."""
    total = reduce(lambda a, b: a + b, boosts, base)
    return F.greatest(F.least(total, F.lit(10)), F.lit(1))


def urgent(score: Column, pos: Column, neg: Column, records: Column,
           min_score: int = fv.URGENT_MIN_SCORE) -> Column:
    """High score, no stale sign, and fresh or large."""
    return (score >= min_score) & ~neg & (pos | (records >= fv.URGENT_MIN_RECORDS))


def confidence(records: Column, types: Column) -> Column:
    """R12."""
    known, kinds = records > 0, F.size(types)
    return (
        F.when(known & (kinds >= 2), "high").when(known | (kinds >= 1), "medium").otherwise("low")
    )


def summary(site: Column, cat: Column, records: Column, types: Column, pos: Column, neg: Column,
            phrases: Phrases = ENGLISH) -> Column:
    """One sentence from the wording in ``phrases``."""
    names = None
    for key, label in phrases.category_names.items():
        names = F.when(cat == key, label) if names is None else names.when(cat == key, label)
    millions = F.floor(records / F.lit(1_000_000))
    size = (
        F.when(records >= 1_000_000, fill(phrases.size_millions, n=millions))
        .when(records >= 1_000, fill(phrases.size_count, n=records))
        .otherwise(phrases.size_unknown)
    )
    joined = F.when(F.size(types) > 0, F.array_join(types, phrases.types_joiner)).otherwise(
        phrases.types_unknown
    )
    note = F.when(neg, phrases.stale_note).when(pos, phrases.fresh_note).otherwise("")
    return fill(
        phrases.summary,
        site=F.when(text_or_empty(site) == "", phrases.site_unknown).otherwise(site),
        category=names.otherwise(phrases.other_category),
        size=size,
        types=joined,
        freshness=note,
    )


def tags(types: Column, cat: Column, pos: Column, neg: Column, tier1: Column, tier2: Column,
         ransom: Column) -> Column:
    """Types, category, freshness and site labels, in this order."""
    labels = F.array(
        cat,
        F.when(pos, "fresh"),
        F.when(neg, "stale"),
        F.when(tier1, "tier1-forum"),
        F.when(tier2, "tier2-forum"),
        F.when(ransom, "ransomware-site"),
    )
    return F.concat(types, F.array_compact(labels))


def reasoning(base: Column, types_boost: Column, freshness: Column, site: Column, final: Column,
              records: Column, types: Column) -> Column:
    """Every component of the score."""
    return fill(
        REASONING_RULES,
        base=base, types_boost=types_boost, freshness=freshness, site=site, final=final,
        records=records, types=F.array_join(types, " "),
    )


def _component_steps(rules: RuleBook) -> list[dict[str, Column]]:
    """The score components in steps; a step uses the columns of the steps before."""
    c = F.col
    scored = c("vendor").isNull()
    ruled = scored & ~c("combo")
    none = F.array().cast("array<string>")
    text_pass = {"hits": rule_keywords(rules).hits(c("text")), "counted": max_records(c("text"))}
    return [
        text_pass,
        {"vendor": vendor_match(c("hits"), rules)},
        {
            "records": F.when(scored, c("counted")).otherwise(-1),
            "found": F.when(scored, data_types(c("hits"), rules)).otherwise(none),
        },
        {
            "combo": is_combo(c("found")),
            "base": records_score(c("records")),
            "types": F.array_remove(c("found"), "combo"),
        },
        {
            "pos": F.when(ruled, fresh_positive(c("hits"), rules)).otherwise(False),
            "neg": F.when(ruled, fresh_negative(c("hits"), rules)).otherwise(False),
            "rule_category": F.when(ruled, category(c("hits"), c("types"), c("site"), rules)),
            "tier1": in_tier1(c("site"), rules),
            "tier2": in_tier2(c("site"), rules),
            "ransom": in_ransom(c("site"), rules),
            "types_boost": type_boost(c("types")),
        },
        {"freshness": freshness_boost(c("pos"), c("neg")), "site_points": site_boost(c("tier1"))},
        {"final": final_score(c("base"), c("types_boost"), c("freshness"), c("site_points"))},
    ]


def score_components(
    items: DataFrame,
    rules: RuleBook = DEFAULT_RULES,
    body_col: str = "content",
    keep: tuple[str, ...] = ("id", "site_name"),
) -> DataFrame:
    """The inputs of the final score, one column each, next to the ``keep`` columns."""
    text_pass, *steps = reuse("score components", (rules,), lambda: _component_steps(rules))
    read = items.select(
        *keep,
        scoring_text(F.col("title"), F.col(body_col)).alias("text"),
        F.lower(text_or_empty(F.col("site_name"))).alias("site"),
    )
    # the two passes over the text happen here, once
    staged = settle(read, [*keep, "site"], text_pass)
    for step in steps:
        staged = staged.withColumns(step)
    return staged.drop("hits", "counted", "found")


def _result_columns(phrases: Phrases, urgent_min_score: int) -> dict[str, Column]:
    c = F.col
    vendor, combo = c("vendor").isNotNull(), c("combo")
    is_urgent = urgent(c("final"), c("pos"), c("neg"), c("records"), urgent_min_score)

    def choose(on_vendor: Column, on_combo: Column, on_rules: Column) -> Column:
        return F.when(vendor, on_vendor).when(combo, on_combo).otherwise(on_rules)

    return {
        "score": choose(F.lit(2), combo_score(c("base")), c("final")).cast("int"),
        "category": choose(F.lit("general_discussion"), F.lit("credential_leak"), c("rule_category")),
        "tags": choose(
            F.array(F.lit("vendor-ad"), F.lit("low-value")),
            F.concat(c("types"), F.array(F.lit("combo-aggregate"))),
            tags(c("types"), c("rule_category"), c("pos"), c("neg"), c("tier1"), c("tier2"), c("ransom")),
        ),
        "summary": choose(
            fill(phrases.vendor_summary, site=text_or_empty(c("site_name"))),
            fill(phrases.combo_summary, site=text_or_empty(c("site_name"))),
            summary(c("site_name"), c("rule_category"), c("records"), c("types"), c("pos"), c("neg"), phrases),
        ),
        "affected_targets": F.array().cast("array<string>"),
        "estimated_records": c("records").cast("int"),
        "data_types": c("types"),
        "is_urgent": choose(F.lit(False), F.lit(False), is_urgent),
        "confidence_level": choose(F.lit("low"), F.lit("low"), confidence(c("records"), c("types"))),
        "reasoning": choose(
            fill(REASONING_VENDOR, word=c("vendor")),
            fill(REASONING_COMBO, score=combo_score(c("base"))),
            reasoning(c("base"), c("types_boost"), c("freshness"), c("site_points"), c("final"),
                      c("records"), c("types")),
        ),
    }


def score_items(
    items: DataFrame,
    rules: RuleBook = DEFAULT_RULES,
    phrases: Phrases = ENGLISH,
    body_col: str = "content",
    urgent_min_score: int = fv.URGENT_MIN_SCORE,
    keep: tuple[str, ...] = ("id",),
) -> DataFrame:
    """The ``keep`` columns and the scoring result, one flat row per item.

    A vendor pattern ends scoring first, a combined list second; all other rows get
    the sum of base score and boosts.
    """
    wanted = tuple(dict.fromkeys((*keep, "site_name")))
    parts = score_components(items, rules, body_col, wanted)
    columns = reuse(
        f"score result {urgent_min_score}", (phrases,), lambda: _result_columns(phrases, urgent_min_score)
    )
    return settle(parts, keep, columns)


RESULT_FIELDS = (
    "score", "category", "tags", "summary", "affected_targets", "estimated_records",
    "data_types", "is_urgent", "confidence_level", "reasoning",
)


def as_analysis(
    scored: DataFrame, analyzed_at: Column, model_used: Column | None = None, id_col: str = "id"
) -> DataFrame:
    """Scored rows in the shape of the analysis table."""
    return scored.select(
        F.col(id_col).alias("item_id"),
        *RESULT_FIELDS,
        (model_used if model_used is not None else F.lit(fv.RULES_PROVIDER)).alias("model_used"),
        analyzed_at.alias("analyzed_at"),
    )
