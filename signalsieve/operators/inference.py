"""Model-assisted scoring as a batch job: prompt building, result parsing, provider
choice, and running a user's scorer over partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from signalsieve import schemas
from signalsieve.functions import fixed_values as fv
from signalsieve.functions.matching import contained_words, let
from signalsieve.functions.phrases import ENGLISH, Phrases
from signalsieve.functions.text import effective_body, text_or_empty, trim_space
from signalsieve.operators.scoring import RESULT_FIELDS
from signalsieve.operators.settle import settle

# Phrases pointed out to the model.
RECORD_PHRASE = (
    r"(?i)[0-9][0-9,.]*+[\t\n\f\r ]*+(?:million|m|k|thousand|billion)?[\t\n\f\r ]*+"
    r"(?:records?|rows?|users?|accounts?|lines?|entries|credentials?|combos?)"
)
SIZE_PHRASE = r"(?i)[0-9][0-9.]*+[\t\n\f\r ]*+(?:gb|tb|mb|gigabyte|terabyte)"
CVE_ID = r"(?i)CVE-[0-9]{4}-[0-9]{4,}"

PROMPT_INSTRUCTIONS = (
    "Rate the post above and answer with one JSON object of the agreed schema.\n"
    "Write the summary field in {language}.\n"
    "A download list is a sign that data exists. With little evidence choose the lower score."
)


def signals(title: Column, body: Column, max_cves: int = 0) -> Column:
    """L1: quantities, all CVE ids (or the first ``max_cves``) and sensitive words of the post; null when none."""
    text = F.concat(text_or_empty(title), F.lit(" "), text_or_empty(body))
    return let(text, lambda t: _signals_of(t, max_cves))


def _signals_of(text: Column, max_cves: int) -> Column:
    records = trim_space(F.regexp_extract(text, RECORD_PHRASE, 0))
    size = trim_space(F.regexp_extract(text, SIZE_PHRASE, 0))
    ids = F.regexp_extract_all(text, F.lit(CVE_ID), F.lit(0))
    cves = F.array_join(F.slice(ids, 1, max_cves) if max_cves > 0 else ids, ", ")
    words = F.array_join(contained_words(F.lower(text), fv.SENSITIVE_FIELDS), ", ")

    def line(label: str, value: Column) -> Column:
        return let(value, lambda v: F.when(v != "", F.concat(F.lit(f"\n  {label}: "), v)).otherwise(""))

    found = F.concat(line("Records", records), line("DataSize", size), line("CVEs", cves),
                     line("SensitiveFields", words))
    return let(found, lambda lines: F.when(lines != "", F.concat(F.lit("PreExtracted:"), lines)))


def prompt(max_chars: int = 0, phrases: Phrases = ENGLISH) -> Column:
    """L2: user message for one item (columns of the item table)."""
    c = F.col
    full = text_or_empty(c("full_content"))
    body = trim_space(effective_body(c("full_content"), c("content"), max_chars))
    title = trim_space(text_or_empty(c("title")))

    def optional(label: str, value: Column) -> Column:
        return F.when(text_or_empty(value) != "", F.concat(F.lit(label), value))

    links = F.filter(F.transform("download_links", trim_space), lambda u: u != "")
    head = [
        F.lit("--- item ---"),
        F.concat(F.lit("site: "), text_or_empty(c("site_name"))),
        F.concat(F.lit("title: "), title),
        optional("dated: ", c("pub_date")),
        optional("by: ", c("author")),
        F.when(
            F.size(links) > 0,
            F.concat(F.lit("links:\n"), F.array_join(F.transform(links, lambda u: F.concat(F.lit("  - "), u)), "\n")),
        ),
        F.when(full != "", "text (whole page):").otherwise("text (teaser):"),
    ]
    tail = [F.lit("--- end ---"), F.lit(PROMPT_INSTRUCTIONS.format(language=phrases.language))]

    def assemble(text: Column) -> Column:
        shown = F.when(text == "", "(none)").otherwise(text)
        return F.concat_ws("\n", *head, shown, signals(title, text), *tail)

    return let(body, assemble)


_CORRUPT = "_bad"
_PARSE_SCHEMA = StructType(schemas.RESULT.fields + [StructField(_CORRUPT, StringType())])


def parse_result(df: DataFrame, json_col: str = "json") -> DataFrame:
    """L3: adds ``result`` (struct) and ``error``; exactly one of them is set."""
    read = F.from_json(F.col(json_col), _PARSE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    # settled twice, so that filters on the outcome do not spell the parser out again
    parsed = settle(df, df.columns, {"_r": read})
    r = F.col("_r")
    score = F.coalesce(r["score"], F.lit(0))
    blank = trim_space(text_or_empty(F.col(json_col))) == ""
    # a parser stops at the end of the first value; as the first of exactly two list items it must stand alone
    listed = F.try_parse_json(F.concat(F.lit("["), F.col(json_col), F.lit(",0]")))
    alone = F.coalesce(F.try_variant_get(listed, "$[1]", "int") == 0, F.lit(False)) & F.try_variant_get(
        listed, "$[2]", "string").isNull()
    error = (
        F.when(blank | r.isNull() | r[_CORRUPT].isNotNull() | ~alone, "unparsable result")
        .when(~score.between(1, 10), F.concat(F.lit("score "), score.cast("string"), F.lit(" out of range [1, 10]")))
        .when(text_or_empty(r["category"]) == "", "category is empty")
    )
    judged = settle(parsed, [*df.columns, "_r"], {"error": error})
    return judged.select(*df.columns, "error", F.when(F.col("error").isNull(), _clean_result(r)).alias("result"))


def _clean_result(r: Column) -> Column:
    empty = F.array().cast("array<string>")
    defaults = {
        "tags": empty, "affected_targets": empty, "data_types": empty, "summary": F.lit(""),
        "reasoning": F.lit(""), "confidence_level": F.lit(""), "is_urgent": F.lit(False),
        "estimated_records": F.lit(0),
    }
    return F.struct(
        *[(F.coalesce(r[n], defaults[n]) if n in defaults else r[n]).alias(n) for n in RESULT_FIELDS]
    )


def emergency_result(phrases: Phrases = ENGLISH) -> Column:
    """The result when no provider and no rule answered."""
    empty = F.array().cast("array<string>")
    values = {
        "score": F.lit(1), "category": F.lit("other"), "tags": F.array(F.lit("fallback")),
        "summary": F.lit(phrases.all_failed), "affected_targets": empty,
        "estimated_records": F.lit(-1), "data_types": empty, "is_urgent": F.lit(False),
        "confidence_level": F.lit("low"), "reasoning": F.lit(fv.REASONING_FALLBACK),
    }
    return F.struct(*[values[n].alias(n) for n in RESULT_FIELDS])


def first_valid(results: DataFrame) -> DataFrame:
    """First valid result per item from (item_id, provider, ord, json, error) rows."""
    valid = (
        parse_result(results.withColumnRenamed("error", "_call_error"))
        .filter(F.col("_call_error").isNull() & F.col("error").isNull())
        .select("item_id", "provider", "ord", "result")
    )
    order = Window.partitionBy("item_id").orderBy("ord", "provider")
    return valid.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank", "ord")


def provider_chain(
    items: DataFrame, results: DataFrame, rules: DataFrame | None, phrases: Phrases = ENGLISH
) -> DataFrame:
    """L4: per item the first provider with a valid result, the rules last, L5 at the end.

    ``items`` holds ``id``; ``rules`` is the output of ``score_items`` (or None).
    Returns (item_id, result, model_used).
    """
    ids = items.select(F.col("id").alias("item_id"))
    out = ids.join(first_valid(results), "item_id", "left")
    if rules is not None:
        by_rules = rules.select(
            F.col("id").alias("item_id"), F.struct(*RESULT_FIELDS).alias("_rules")
        )
        out = out.join(by_rules, "item_id", "left")
    else:
        out = out.withColumn("_rules", F.lit(None).cast(schemas.RESULT))
    return out.select(
        "item_id",
        F.coalesce("result", "_rules", emergency_result(phrases)).alias("result"),
        F.coalesce(
            "provider",
            F.when(F.col("_rules").isNotNull(), fv.RULES_PROVIDER),
            F.lit(fv.FALLBACK_PROVIDER),
        ).alias("model_used"),
    )


INFER_COLUMNS = ("id", "title", "content", "full_content", "site_name", "pub_date", "author", "download_links")
INFER_SCHEMA = "item_id bigint, json string, error string"


def infer(items: DataFrame, scorer: Callable[[dict], dict | str]) -> DataFrame:
    """Run a user's scorer on every item, Arrow batch by Arrow batch.

    ``scorer`` takes one item as a dict and returns the result as a dict or JSON text; what
    it raises becomes the row's ``error`` and the job goes on.
    """

    def run(batches: Iterator) -> Iterator:
        import json

        import pandas as pd

        for batch in batches:
            ids, texts, errors = [], [], []
            for row in batch.to_dict("records"):
                ids.append(row["id"])
                try:
                    answer = scorer(row)
                    texts.append(answer if isinstance(answer, str) else json.dumps(answer, default=_plain))
                    errors.append(None)
                except Exception as exc:  # one bad item must not fail the job
                    texts.append(None)
                    errors.append(f"{type(exc).__name__}: {exc}")
            yield pd.DataFrame({"item_id": ids, "json": texts, "error": errors})

    def _plain(value):
        return value.tolist() if hasattr(value, "tolist") else str(value)

    have = [n for n in INFER_COLUMNS if n in items.columns]
    return items.select(*have).mapInPandas(run, INFER_SCHEMA)


def rubric_check(results: DataFrame) -> DataFrame:
    """Results that break the stated limits, with the limit they break."""
    broken = F.array_compact(
        F.array(
            F.when((F.col("confidence_level") == "low") & (F.col("score") > 4), "low confidence above 4"),
            F.when(F.col("is_urgent") & (F.col("score") < 8), "urgent below 8"),
        )
    )
    return results.withColumn("violations", broken).filter(F.size("violations") > 0)
