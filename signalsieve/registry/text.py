"""Queries of the text, triage and scoring operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalsieve.functions import fixed_values as fv
from signalsieve.functions import text as T
from signalsieve.functions.numbers import max_records, records_score
from signalsieve.operators import scoring as S
from signalsieve.operators import triage as TR
from signalsieve.registry.base import (
    ITEMS_ALL,
    RESULT_COLUMNS,
    any_in,
    parts_cte,
    query,
    scored_cte,

    triage_cte,
)
from signalsieve.registry.views import items_all, table

c = F.col
lit = F.lit


@query("t1_strip_html", r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  html || '<p>You must be registered for see links</p> end', '<[^>]+>', ' ', 'g'),
  '(?i)You must be registered for see (links|images attach)', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS plain
FROM pages""")
def _(spark, sf):
    html = F.concat("html", F.lit("<p>You must be registered for see links</p> end"))
    return table(spark, sf, "pages").select("page_id", T.strip_html(html).alias("plain"))


@query("t2_join_categories", """
SELECT doc_id, array_to_string(list_filter([lang, '', source, NULL], lambda x: x IS NOT NULL AND x <> ''), ', ') AS category
FROM documents""")
def _(spark, sf):
    names = F.array("lang", F.lit(""), "source", F.lit(None).cast("string"))
    return table(spark, sf, "documents").select("doc_id", T.join_categories(names).alias("category"))


@query("t3_teaser", f"""WITH {ITEMS_ALL}
SELECT id, regexp_replace(regexp_replace(regexp_replace(
  CASE WHEN full_content <> '' THEN full_content ELSE '<p>' || content || '</p>' END, '<[^>]+>', ' ', 'g'),
  '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS teaser FROM it_all""")
def _(spark, sf):
    described = F.concat(F.lit("<p>"), "content", F.lit("</p>"))
    return items_all(spark, sf).select("id", T.teaser(c("full_content"), described).alias("teaser"))


_LINK_TEXT = """(html || ' Download: ' || url || '/files/' || page_id || '.zip). <a href="' || url || '">x</a> '
  || url || '/login/a.zip ' || url || '/download/p' || page_id || ', ' || url || '/i.png https://mega.nz/f' || page_id || ';')"""
_FOUND = r"""list_concat(list_concat(list_concat(list_concat(
  regexp_extract_all(t, '(?i)https?://[^\s"<>]+\.(?:zip|rar|7z|txt|csv|xlsx|pdf|exe|iso|torrent|json|xml)', 0),
  regexp_extract_all(t, '(?i)href=["''](https?://[^\s"<>'']+)["'']', 1)),
  regexp_extract_all(t, '(?i)[Dd]ownload\s*[:：]\s*(https?://[^\s"<>]+)', 1)),
  regexp_extract_all(t, '(?i)(https?://[^\s"<>]+/(?:download|files?)/[^\s"<>]+)', 1)),
  regexp_extract_all(t, '(?i)(https?://(?:mega\.nz|mediafire\.com|sendspace\.com|4shared\.com)/[^\s"<>]+)', 1))"""


@query("t4_download_links", f"""
WITH x AS (SELECT page_id, {_LINK_TEXT} AS t FROM pages),
y AS (SELECT page_id, list_filter(list_transform({_FOUND}, lambda u: rtrim(u, '.,;)')),
        lambda u: starts_with(u, 'http') AND NOT {any_in('lower(u)', fv.LINK_EXCLUDES)}) AS found FROM x)
SELECT page_id, array_to_string(list_filter(found, lambda u, i: list_position(found, u) = i), '|') AS links FROM y""")
def _(spark, sf):
    url, page = c("url"), c("page_id").cast("string")
    text = F.concat(
        "html", F.lit(" Download: "), url, F.lit("/files/"), page, F.lit('.zip). <a href="'), url, F.lit('">x</a> '),
        url, F.lit("/login/a.zip "), url, F.lit("/download/p"), page, F.lit(", "), url,
        F.lit("/i.png https://mega.nz/f"), page, F.lit(";"),
    )
    return table(spark, sf, "pages").select("page_id", T.download_links(text).alias("links"))


@query("t5_prefix_title", """
SELECT conv_id, turn, CASE WHEN starts_with(t, '[') THEN t ELSE '[' || role || '] ' || t END AS title
FROM (SELECT *, CASE WHEN turn = 0 THEN '[GROUP] ' || text ELSE text END AS t FROM conversations) x""")
def _(spark, sf):
    title = F.when(c("turn") == 0, F.concat(F.lit("[GROUP] "), "text")).otherwise(c("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.prefix_title(title, c("role")).alias("title"))


@query("t6_preview", """
SELECT doc_id, CASE WHEN length(text) > 64 THEN substr(text, 1, 64) || '…' ELSE text END AS preview_64,
  CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '…' ELSE text END AS preview_300,
  CASE WHEN length(text) > 80 THEN substr(text, 1, 77) || '...' ELSE text END AS short_80 FROM documents""")
def _(spark, sf):
    text = c("text")
    return table(spark, sf, "documents").select(
        "doc_id", T.preview(text, 64).alias("preview_64"), T.preview(text, 300).alias("preview_300"),
        T.shorten(text, 80).alias("short_80"),
    )


@query("t7_effective_body", f"""WITH {ITEMS_ALL},
b AS (SELECT id, CASE WHEN full_content <> '' THEN full_content ELSE content END AS body FROM it_all)
SELECT id, body, CASE WHEN length(trim(body, ' \t\n\r')) > 500 THEN substr(trim(body, ' \t\n\r'), 1, 497) || '...'
  ELSE trim(body, ' \t\n\r') END AS capped FROM b""")
def _(spark, sf):
    return items_all(spark, sf).select(
        "id",
        T.effective_body(c("full_content"), c("content")).alias("body"),
        T.effective_body(c("full_content"), c("content"), 500).alias("capped"),
    )


@query("t8_site_badge", f"""WITH {ITEMS_ALL}
SELECT id, CASE {' '.join(f"WHEN {any_in('lower(site_name)', w)} THEN '{n}'" for n, w in fv.SITE_BADGES)}
  ELSE 't4' END AS badge FROM it_all""")
def _(spark, sf):
    return items_all(spark, sf).select("id", T.site_badge(c("site_name")).alias("badge"))


@query("t9_score_badge", """
SELECT score, CASE WHEN score >= 9 THEN '🔴' WHEN score >= 7 THEN '🟠' WHEN score >= 5 THEN '🟡' ELSE '🔵' END AS badge,
  count(*) AS n FROM (SELECT CAST(l_linenumber + l_orderkey % 4 AS INTEGER) AS score FROM lineitem) x GROUP BY ALL""")
def _(spark, sf):
    score = (c("l_linenumber") + c("l_orderkey") % 4).cast("int").alias("score")
    rows = table(spark, sf, "lineitem").select(score)
    return rows.groupBy("score", T.score_badge(c("score")).alias("badge")).agg(F.count(F.lit(1)).alias("n"))


@query("t10_escape_markup", r"""
SELECT doc_id, regexp_replace(text || ' `a_b*c` ~x~ {y} |z|', '([_*\[\]()~`>#+\-=|{}.!])', '\\\1', 'g') AS escaped
FROM documents""")
def _(spark, sf):
    text = F.concat("text", F.lit(" `a_b*c` ~x~ {y} |z|"))
    return table(spark, sf, "documents").select("doc_id", T.escape_markup(text).alias("escaped"))


@query("t10_escape_url", r"""
SELECT page_id, replace(replace(url || '(1)\x', '\', '\\'), ')', '\)') AS escaped FROM pages""")
def _(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", T.escape_url(F.concat("url", F.lit("(1)\\x"))).alias("escaped")
    )


@query("t11_comma_number", "SELECT o_orderkey, format('{:,}', o_orderkey * 3777) AS shown FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.comma_number(c("o_orderkey") * 3777).alias("shown"))


# ── triage ────────────────────────────────────────────────────────────────────────────
_TRI = f"WITH {ITEMS_ALL}," + triage_cte("it_all")


@query("f1_named_target", _TRI + " SELECT id, named FROM tri")
def _(spark, sf):
    return items_all(spark, sf).select("id", TR.named_target(c("title")).alias("named"))


@query("f2_skip_reason", _TRI + " SELECT id, skip AS reason FROM tri")
def _(spark, sf):
    return items_all(spark, sf).select("id", TR.skip_reason(c("title")).alias("reason"))


@query("f3_triage", _TRI + " SELECT id, action, reason FROM tri")
def _(spark, sf):
    return TR.triage(items_all(spark, sf)).select("id", "action", "reason")


def _rule_tables(spark):
    skips = spark.createDataFrame(
        [(i, k, r) for i, (k, r) in enumerate(fv.SKIP_PATTERNS)], "ord int, keyword string, reason string"
    )
    return skips, spark.createDataFrame([(k,) for k in fv.NAMED_TARGETS], "keyword string")


@query("f4_triage_join", _TRI + " SELECT id, action, reason FROM tri")
def _(spark, sf):
    return TR.triage_join(items_all(spark, sf), *_rule_tables(spark)).select("id", "action", "reason")


_TABLE_RULES = """WITH t AS (
  SELECT doc_id % 97 AS id, CASE doc_id % 4 WHEN 0 THEN 'a Data dump' WHEN 1 THEN 'data and named thing' WHEN 2 THEN 'bare rule' ELSE 'x ' || lang END AS title
  FROM documents)
SELECT id, title, CASE WHEN contains(title, 'named') THEN 'analyze' WHEN contains(lower(title), 'data') OR title = 'bare rule' THEN 'skip' ELSE 'analyze' END AS action,
  CASE WHEN contains(title, 'named') THEN 'named target detected' WHEN contains(lower(title), 'data') THEN 'before all' WHEN title = 'bare rule' THEN NULL
       ELSE 'passed default' END AS reason FROM t"""


@query("f4_triage_join_odd_rules", _TABLE_RULES)
def _(spark, sf):
    """Shared ids, a negative ord, a rule without a reason."""
    d = c("doc_id")
    title = (F.when(d % 4 == 0, "a Data dump").when(d % 4 == 1, "data and named thing").when(d % 4 == 2, "bare rule")
             .otherwise(F.concat(lit("x "), c("lang"))))
    rows = table(spark, sf, "documents").select((d % 97).alias("id"), title.alias("title"))
    skips = spark.createDataFrame([(-1, "data", "before all"), (3, "dump", "late"), (4, "bare", None), (0, "", "empty"), (0, None, "none")],
                                  "ord int, keyword string, reason string")
    return TR.triage_join(rows, skips, spark.createDataFrame([("Named",)], "keyword string"))


@query("f4_triage_join_by_anchor", _TRI + " SELECT id, action, reason FROM tri")
def _(spark, sf):
    rows = TR.triage_join(items_all(spark, sf), *_rule_tables(spark))
    return rows.select("id", "action", "reason")


# ── scoring ───────────────────────────────────────────────────────────────────────────
_PARTS = f"WITH {ITEMS_ALL}," + parts_cte("it_all")
_SCORED = _PARTS + "," + scored_cte()


def _parts(spark, sf):
    return S.score_components(items_all(spark, sf, heavy=True))


def _scored(spark, sf):
    return S.score_items(items_all(spark, sf, heavy=True))


@query("r1_vendor_match", _PARTS + " SELECT id, vendor FROM parts")
def _(spark, sf):
    return _parts(spark, sf).select("id", "vendor")


@query("r2_max_records", _PARTS.replace("vendor IS NOT NULL THEN 0", "false THEN 0") + " SELECT id, records FROM parts")
def _(spark, sf):
    rows = items_all(spark, sf, heavy=True)
    return rows.select("id", max_records(S.scoring_text(c("title"), c("content"))).alias("records"))


@query("r3_records_score", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(n AS INTEGER) AS records,
  CAST(CASE WHEN n >= 100000000 THEN 9 WHEN n >= 10000000 THEN 8 WHEN n >= 1000000 THEN 7 WHEN n >= 100000 THEN 6
    WHEN n >= 10000 THEN 5 WHEN n >= 1000 THEN 4 WHEN n > 0 THEN 3 ELSE 2 END AS INTEGER) AS base
FROM (SELECT *, CAST(l_quantity - 1 AS BIGINT) * l_partkey * 11 AS n FROM lineitem) x""")
def _(spark, sf):
    n = (F.col("l_quantity") - 1).cast("bigint") * c("l_partkey") * 11
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", n.cast("int").alias("records"), records_score(n).alias("base")
    )


@query("r4_data_types", _PARTS + " SELECT id, array_to_string(types, '|') AS types, combo FROM parts")
def _(spark, sf):
    return _parts(spark, sf).select("id", "types", "combo")


@query("r5_combo_cap", _SCORED + """ SELECT id, score, ai_category AS category, array_to_string(tags, '|') AS tags,
  is_urgent FROM scored WHERE combo""")
def _(spark, sf):
    rows = _scored(spark, sf)
    return rows.filter(F.array_contains("tags", "combo-aggregate")).select("id", "score", "category", "tags", "is_urgent")


@query("r6_type_boost", _PARTS + " SELECT id, types_boost FROM parts")
def _(spark, sf):
    return _parts(spark, sf).select("id", "types_boost")


@query("r7_freshness", _PARTS + " SELECT id, pos, neg, freshness FROM parts")
def _(spark, sf):
    return _parts(spark, sf).select("id", "pos", "neg", "freshness")


@query("r8_site_boost", _PARTS + " SELECT id, tier1, tier2, ransom, site_points FROM parts")
def _(spark, sf):
    return _parts(spark, sf).select("id", "tier1", "tier2", "ransom", "site_points")


@query("r9_category", _PARTS + " SELECT id, rule_category FROM parts")
def _(spark, sf):
    return _parts(spark, sf).select("id", "rule_category")


@query("r10_final_score", _PARTS + " SELECT id, base, final FROM parts")
def _(spark, sf):
    return _parts(spark, sf).select("id", "base", "final")


@query("r11_urgent", _SCORED + " SELECT id, score, is_urgent FROM scored")
def _(spark, sf):
    return _scored(spark, sf).select("id", "score", "is_urgent")


@query("r12_confidence", _SCORED + " SELECT id, confidence_level FROM scored")
def _(spark, sf):
    return _scored(spark, sf).select("id", "confidence_level")


@query("r13_summary", _SCORED + " SELECT id, summary FROM scored")
def _(spark, sf):
    return _scored(spark, sf).select("id", "summary")


@query("r14_tags", _SCORED + " SELECT id, array_to_string(tags, '|') AS tags FROM scored")
def _(spark, sf):
    return _scored(spark, sf).select("id", "tags")


@query("r15_reasoning", _SCORED + " SELECT id, reasoning FROM scored")
def _(spark, sf):
    return _scored(spark, sf).select("id", "reasoning")


@query("r16_score_items", _SCORED + f""" SELECT id, {RESULT_COLUMNS.replace('category,', 'ai_category AS category,', 1)} FROM scored""")
def _(spark, sf):
    return _scored(spark, sf)
