"""Title triage: which posts are worth scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalsieve.functions import fixed_values as fv
from signalsieve.functions.fixed_values import DEFAULT_RULES, RuleBook
from signalsieve.functions.keywords import KeywordIndex
from signalsieve.functions.reuse import reuse
from signalsieve.functions.text import text_or_empty
from signalsieve.operators.settle import settle

ANALYZE = "analyze"
SKIP = "skip"
ANCHOR_CHARS = 3


def title_keywords(rules: RuleBook = DEFAULT_RULES) -> KeywordIndex:
    """Every keyword that is looked for in a title, found in one pass."""
    return reuse(
        "title keywords", (rules,),
        lambda: KeywordIndex(rules.named_targets, [word for word, _ in rules.skip_patterns]),
    )


def _title_hits(title: Column, rules: RuleBook) -> Column:
    return title_keywords(rules).hits(F.lower(text_or_empty(title)))


def named_target(title: Column, rules: RuleBook = DEFAULT_RULES) -> Column:
    """the title names a target that always goes to scoring."""
    return title_keywords(rules).any(_title_hits(title, rules), rules.named_targets)


def skip_reason(title: Column, rules: RuleBook = DEFAULT_RULES) -> Column:
    """reason of the first skip pattern in the title, null when none matches."""
    return title_keywords(rules).first(_title_hits(title, rules), rules.skip_patterns)


def triage(df: DataFrame, rules: RuleBook = DEFAULT_RULES, title_col: str = "title") -> DataFrame:
    """adds ``action`` and ``reason``; a named target beats every skip pattern."""
    tests = reuse("triage", (rules,), lambda: _triage_tests(rules))
    staged = df.withColumn("_hits", _title_hits(F.col(title_col), rules)).withColumns(tests)
    return settle(staged, df.columns, _decision(F.col("_named"), F.col("_skip")))


def _triage_tests(rules: RuleBook) -> dict[str, Column]:
    index, hits = title_keywords(rules), F.col("_hits")
    return {"_named": index.any(hits, rules.named_targets), "_skip": index.first(hits, rules.skip_patterns)}


def _decision(named: Column, skip: Column) -> dict[str, Column]:
    return {
        "action": F.when(~named & skip.isNotNull(), SKIP).otherwise(ANALYZE),
        "reason": F.when(named, fv.REASON_NAMED_TARGET).when(skip.isNotNull(), skip).otherwise(fv.REASON_DEFAULT),
    }


def triage_join(
    df: DataFrame, skip_rules: DataFrame, named_targets: DataFrame, title_col: str = "title"
) -> DataFrame:
    """F3 with the rules held in tables, ``(ord, keyword, reason)`` and ``(keyword)``.

    One plan whatever the number of rules: the distinct titles give their pieces of up to ANCHOR_CHARS
    characters, pieces that no rule starts with drop out, and what meets a rule is checked whole. Only a
    hash of the title travels with the pieces. Verdicts belong to titles, so rows may share an id.

    Of several skip rules the smallest ``ord`` decides, then the keyword. A rule without a reason skips
    with a null reason; null and empty keywords match nothing.
    """
    rules = skip_rules.select(
        F.lit(False).alias("named"), "ord", F.lower("keyword").alias("keyword"), "reason"
    ).unionByName(named_targets.select(
        F.lit(True).alias("named"), F.lit(None).cast(skip_rules.schema["ord"].dataType).alias("ord"),
        F.lower("keyword").alias("keyword"), F.lit(None).cast("string").alias("reason"),
    )).where(F.char_length("keyword") > 0).withColumn("anchor", F.substring("keyword", 1, ANCHOR_CHARS))
    low = F.lower(text_or_empty(F.col(title_col)))
    titles = df.select(low.alias("_low")).distinct().withColumn("_title", F.xxhash64("_low"))
    pieces = titles.where(F.char_length("_low") > 0).select("_title", F.explode(_grams(F.col("_low"))).alias("anchor"))
    met = (
        pieces.join(rules.select("anchor").distinct(), "anchor", "left_semi")
        .join(rules, "anchor")
        .join(titles, "_title")
        .where(F.col("_low").contains(F.col("keyword")))
    )
    first = F.min(F.when(~F.col("named"), F.struct("ord", "keyword", "reason")))
    best = met.groupBy("_low").agg(F.bool_or("named").alias("_named"), first.alias("_skip"))
    joined = df.withColumn("_low", low).join(best, "_low", "left")
    named = F.coalesce("_named", F.lit(False))
    skipped = ~named & F.col("_skip").isNotNull()
    return joined.select(
        *df.columns,
        F.when(skipped, SKIP).otherwise(ANALYZE).alias("action"),
        F.when(named, fv.REASON_NAMED_TARGET).when(skipped, F.col("_skip.reason")).otherwise(fv.REASON_DEFAULT).alias("reason"),
    )


def _grams(text: Column) -> Column:
    """Distinct substrings of 1 to ANCHOR_CHARS characters."""
    starts = F.sequence(F.lit(1), F.char_length(text))
    return F.array_distinct(
        F.flatten(
            F.array(
                *[
                    _cut(text, starts, n) for n in range(1, ANCHOR_CHARS + 1)
                ]
            )
        )
    )


def _cut(text: Column, starts: Column, n: int) -> Column:
    return F.transform(starts, lambda i: F.substr(text, i, F.lit(n)))
