"""Queries of the model-assisted scoring operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalsieve.functions import fixed_values as fv
from signalsieve.operators import inference as L
from signalsieve.operators.scoring import score_items
from signalsieve.operators.triage import ANALYZE, triage
from signalsieve.registry.base import ANALYSIS, ITEMS_ALL, query, sql_list
from signalsieve.registry.views import items_all, items_unique, table

c, lit = F.col, F.lit


def _signals_sql(text: str) -> str:
    nouns = "records?|rows?|users?|accounts?|lines?|entries|credentials?|combos?"
    return rf"""(SELECT CASE WHEN a || b || v || w <> '' THEN 'PreExtracted:'
    || CASE WHEN a <> '' THEN chr(10) || '  Records: ' || a ELSE '' END || CASE WHEN b <> '' THEN chr(10) || '  DataSize: ' || b ELSE '' END
    || CASE WHEN v <> '' THEN chr(10) || '  CVEs: ' || v ELSE '' END || CASE WHEN w <> '' THEN chr(10) || '  SensitiveFields: ' || w ELSE '' END END
  FROM (SELECT trim(regexp_extract(t, '(?i)(\d[\d,\.]*)\s*(million|m|k|thousand|billion)?\s*({nouns})')) AS a,
    trim(regexp_extract(t, '(?i)(\d[\d\.]*)\s*(gb|tb|mb|gigabyte|terabyte)')) AS b,
    array_to_string(regexp_extract_all(t, '(?i)CVE-\d{{4}}-\d{{4,}}'), ', ') AS v,
    array_to_string(list_filter({sql_list(fv.SENSITIVE_FIELDS)}, lambda w: contains(lower(t), w)), ', ') AS w
    FROM (SELECT {text} AS t) t0) t1)"""


_EXTRA = "' seen CVE-2024-' || (10000 + x.id) || ' and cve-2023-1 in 2.5 GB' || repeat(' CVE-2021-44228', 7)"


@query("l1_signals", f"WITH {ITEMS_ALL} SELECT id, {_signals_sql('x.title || chr(32) || x.content || ' + _EXTRA)} AS signals FROM it_all x")
def _(spark, sf):
    extra = F.concat(lit(" seen CVE-2024-"), (c("id") + 10000).cast("string"), lit(" and cve-2023-1 in 2.5 GB" + " CVE-2021-44228" * 7))
    return items_all(spark, sf, heavy=True).select(
        "id", L.signals(c("title"), F.concat("content", extra)).alias("signals")
    )


_BODY = r"regexp_replace(CASE WHEN x.full_content <> '' THEN x.full_content ELSE x.content END, '^\s+|\s+$', '', 'g')"


@query("l2_build_prompt", f"""WITH {ITEMS_ALL}
SELECT id, concat_ws(chr(10), '--- item ---', 'site: ' || site_name, 'title: ' || title,
  CASE WHEN pub_date <> '' THEN 'dated: ' || pub_date END, CASE WHEN author <> '' THEN 'by: ' || author END,
  'links:' || chr(10) || '  - ' || download_links[1],
  CASE WHEN full_content <> '' THEN 'text (whole page):' ELSE 'text (teaser):' END, CASE WHEN {_BODY} = '' THEN '(none)' ELSE {_BODY} END,
  {_signals_sql('x.title || chr(32) || ' + _BODY)}, '--- end ---',
  'Rate the post above and answer with one JSON object of the agreed schema.',
  'Write the summary field in English.',
  'A download list is a sign that data exists. With little evidence choose the lower score.') AS prompt FROM it_all x""")
def _(spark, sf):
    return items_all(spark, sf, heavy=True).select("id", L.prompt().alias("prompt"))


# answers of two invented providers, in ten shapes by id
_GOOD = ('{{"score": {score}, "category": "database_dump", "tags": ["a", "b"], "summary": "s", "affected_targets": ["t"], '
         '"estimated_records": 10, "data_types": ["email"], "is_urgent": true, "confidence_level": "high", "reasoning": "r"}}')
_SHAPES = [
    None,
    '{"score": 7, "cat',
    '{"score": 0, "category": "other"}',
    '{"score": 11, "category": "other"}',
    '{"score": 5, "category": ""}',
    '{"score": 4, "category": "other", "unknown": 1}',
    '{"score": 5, "category": "other", "tags": 3}',
    "",
    '{"score": 7, "category": "other"} Hope this helps',
    '{"score": 7, "category": "other"} {"score": 8, "category": "other"}',
]


def _answer(key, score):
    before, after = _GOOD.replace("{{", "{").replace("}}", "}").split("{score}")
    out = F.when(key == 0, F.concat(lit(before), score.cast("string"), lit(after)))
    for i, shape in enumerate(_SHAPES):
        if shape is not None:
            out = out.when(key == i, shape)
    return out


def _answer_sql(key: str, score: str) -> str:
    before, after = _GOOD.replace("{{", "{").replace("}}", "}").split("{score}")
    cases = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SHAPES) if s is not None)
    return f"CASE {key} WHEN 0 THEN '{before}' || {score} || '{after}' {cases} END"


_PARSED = """
SELECT *, CASE WHEN bad THEN 'unparsable result' WHEN score NOT BETWEEN 1 AND 10 THEN 'score ' || score || ' out of range [1, 10]'
  WHEN cat = '' THEN 'category is empty' END AS error
FROM (SELECT *, CASE WHEN ok THEN coalesce(TRY_CAST(json_extract_string(j, '$.score') AS INTEGER), 0) END AS score,
        CASE WHEN ok THEN coalesce(json_extract_string(j, '$.category'), '') END AS cat,
        CASE WHEN ok THEN coalesce(array_to_string(TRY_CAST(json_extract(j, '$.tags') AS VARCHAR[]), '|'), '') END AS tags,
        NOT ok OR (json_type(j, '$.tags') IS NOT NULL AND json_type(j, '$.tags') <> 'ARRAY') AS bad
      FROM (SELECT *, CASE WHEN json_valid(json) THEN json END AS j, json <> '' AND json_valid(json) AS ok FROM {source}) p0) p1"""


@query("l3_parse_result", f"""WITH src AS (SELECT doc_id, {_answer_sql('doc_id % 10', '1 + doc_id % 9')} AS json FROM documents),
p AS ({_PARSED.format(source='src')})
SELECT doc_id, error, CASE WHEN error IS NULL THEN score END AS score, CASE WHEN error IS NULL THEN cat END AS category,
  CASE WHEN error IS NULL THEN tags END AS tags FROM p""")
def _(spark, sf):
    d = c("doc_id")
    rows = table(spark, sf, "documents").select("doc_id", _answer(d % 10, d % 9 + 1).alias("json"))
    out = L.parse_result(rows)
    return out.select("doc_id", "error", *[c(f"result.{n}").alias(n) for n in ("score", "category", "tags")])


_PROVIDED = f"""results AS (
  SELECT id AS item_id, 'alpha' AS provider, 0 AS ord, {_answer_sql('id % 10', '1 + id % 9')} AS json, NULL AS call_error FROM it
  UNION ALL SELECT id, 'beta', 1, {_answer_sql('(id // 10) % 10', '10 - id % 9')}, CASE WHEN id % 5 = 0 THEN 'timeout' END FROM it),
first_ok AS (SELECT item_id, provider, score, cat FROM ({_PARSED.format(source='results')}) p
  WHERE error IS NULL AND call_error IS NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ord) = 1)"""


def provider_results(items):
    i = c("id")
    alpha = items.select(
        i.alias("item_id"), lit("alpha").alias("provider"), lit(0).alias("ord"),
        _answer(i % 10, i % 9 + 1).alias("json"), lit(None).cast("string").alias("error"),
    )
    beta = items.select(
        i.alias("item_id"), lit("beta").alias("provider"), lit(1).alias("ord"),
        _answer(F.floor(i / 10) % 10, 10 - i % 9).alias("json"), F.when(i % 5 == 0, "timeout").alias("error"),
    )
    return alpha.unionByName(beta)


@query("l4_provider_chain", f"""WITH {ANALYSIS}, {_PROVIDED}
SELECT it.id AS item_id, coalesce(f.provider, an.model_used, 'fallback') AS model_used, coalesce(f.score, an.score, 1) AS score,
  coalesce(f.cat, an.category, 'other') AS category
FROM it LEFT JOIN first_ok f ON f.item_id = it.id LEFT JOIN an ON an.item_id = it.id""")
def _(spark, sf):
    items = items_unique(spark, sf)
    rules = score_items(triage(items_unique(spark, sf, heavy=True)).filter(c("action") == ANALYZE))
    out = L.provider_chain(items, provider_results(items), rules)
    return out.select("item_id", "model_used", c("result.score").alias("score"), c("result.category").alias("category"))


@query("l5_emergency_default", f"""WITH {ANALYSIS}, {_PROVIDED}
SELECT it.id AS item_id, coalesce(f.provider, 'fallback') AS model_used, coalesce(f.score, 1) AS score,
  CASE WHEN f.item_id IS NULL THEN 'fallback' ELSE 'other' END AS first_tag
FROM it LEFT JOIN first_ok f ON f.item_id = it.id""".replace("ELSE 'other' END AS first_tag", "WHEN f.cat = 'other' THEN NULL ELSE 'a' END AS first_tag"))
def _(spark, sf):
    items = items_unique(spark, sf)
    out = L.provider_chain(items, provider_results(items), None)
    return out.select(
        "item_id", "model_used", c("result.score").alias("score"), F.get(c("result.tags"), lit(0)).alias("first_tag")
    )


@query("l6_infer", f"""WITH {ITEMS_ALL}
SELECT id AS item_id, CASE WHEN contains(title, 'wordlist') THEN 'ValueError: no answer'
    WHEN length(title) % 12 NOT BETWEEN 1 AND 10 THEN 'score ' || length(title) % 12 || ' out of range [1, 10]' END AS error,
  CASE WHEN NOT contains(title, 'wordlist') AND length(title) % 12 BETWEEN 1 AND 10 THEN CAST(length(title) % 12 AS INTEGER) END AS score,
  CASE WHEN NOT contains(title, 'wordlist') AND length(title) % 12 BETWEEN 1 AND 10 THEN download_links[1] END AS first_tag FROM it_all""")
def _(spark, sf):
    out = L.parse_result(L.infer(items_all(spark, sf, heavy=True), demo_scorer()).withColumnRenamed("error", "call_error"))
    return out.select(
        "item_id", F.coalesce("call_error", "error").alias("error"), c("result.score").alias("score"),
        F.get(c("result.tags"), lit(0)).alias("first_tag"),
    )


def demo_scorer():
    """Stands in for a user's model: deterministic, and it fails on some items. A closure
    reaches the workers without the package."""

    def scorer(row: dict) -> dict:
        if "wordlist" in row["title"]:
            raise ValueError("no answer")
        return {"score": len(row["title"]) % 12, "category": row["site_name"], "tags": list(row["download_links"])}

    return scorer


@query("l7_rubric_check", """
SELECT doc_id, array_to_string(list_filter([CASE WHEN confidence = 'low' AND score > 4 THEN 'low confidence above 4' END,
  CASE WHEN urgent AND score < 8 THEN 'urgent below 8' END], lambda v: v IS NOT NULL), '|') AS violations
FROM (SELECT doc_id, 1 + 5 * quality + 2 * (doc_id % 3) AS score, CASE WHEN toxic = 1 THEN 'low' ELSE 'high' END AS confidence,
        doc_id % 2 = 0 AS urgent FROM labels) x
WHERE (confidence = 'low' AND score > 4) OR (urgent AND score < 8)""")
def _(spark, sf):
    d = c("doc_id")
    rows = table(spark, sf, "labels").select(
        "doc_id", (1 + 5 * c("quality") + 2 * (d % 3)).alias("score"),
        F.when(c("toxic") == 1, "low").otherwise("high").alias("confidence_level"), (d % 2 == 0).alias("is_urgent"),
    )
    return L.rubric_check(rows).select("doc_id", "violations")
