"""Queries of the dedup and stored-query operators."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import functions as F

from signalsieve import schemas
from signalsieve.operators import dedup as D
from signalsieve.operators import store as Q
from signalsieve.operators.keyed import KeyedTable, merge_analysis, merge_items
from signalsieve.registry.base import ANALYSIS, ITEMS, ITEMS_ALL, RESULT_COLUMNS, STORED, query, stamp
from signalsieve.registry.views import (
    NOW,
    analysis_of,
    analysis_unique,
    event_items,
    items_all,
    items_stored,
    items_unique,
    table,
)
from signalsieve.session import ensure_checkpoint_dir
from signalsieve.sources.tables import scan_analysis, scan_items

c = F.col
SINCE, UNTIL = datetime(2024, 1, 5), datetime(2024, 1, 15)
NOTIFIED_BEFORE = datetime(2024, 1, 8)
DAY = date(2024, 1, 5)


@query("s5_scan_tables", f"""WITH {ITEMS}
SELECT id, title, link, pub_date, author, category, content, full_content, array_to_string(download_links, '|') AS download_links,
  site_name, {stamp('created_at')} AS created_at FROM it""")
def _(spark, sf):
    """The items written as a table and scanned back."""
    path = f"{ensure_checkpoint_dir(spark)}/items-{uuid.uuid4().hex}"
    items_unique(spark, sf).select(*schemas.ITEMS.fieldNames()).write.parquet(path)
    return scan_items(spark, path)


@query("s5_scan_analysis", f"""WITH {ANALYSIS}
SELECT item_id, {RESULT_COLUMNS}, model_used, {stamp('analyzed_at')} AS analyzed_at FROM an""")
def _(spark, sf):
    path = f"{ensure_checkpoint_dir(spark)}/analysis-{uuid.uuid4().hex}"
    analysis_unique(spark, sf).write.parquet(path)
    return scan_analysis(spark, path)


# ── dedup and incremental filters ─────────────────────────────────────────────────────
@query("d1_new_items", f"""WITH {STORED}
SELECT id, link, site_name FROM it_all b WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.link = b.link)""")
def _(spark, sf):
    return D.new_items(items_all(spark, sf), items_stored(spark, sf)).select("id", "link", "site_name")


@query("d1_new_items_small_batch", f"""WITH {STORED}
SELECT id, link, site_name FROM it_all b WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.link = b.link)""")
def _(spark, sf):
    return D.new_items_of_small_batch(items_all(spark, sf), items_stored(spark, sf)).select("id", "link", "site_name")


@query("d2_dedup_links", f"WITH {ITEMS} SELECT id, link, source_rank FROM it")
def _(spark, sf):
    return D.dedup_links(items_all(spark, sf)).select("id", "link", "source_rank")


@query("d2_dedup_links_wide_rows", f"WITH {ITEMS} SELECT id, link, content FROM it")
def _(spark, sf):
    return D.dedup_links_of_wide_rows(items_all(spark, sf)).select("id", "link", "content")


@query("d2_dedup_lineitem", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1""")
def _(spark, sf):
    keys = [c(n) for n in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    rows = table(spark, sf, "lineitem").withColumn("link", c("l_orderkey"))
    return D.dedup_links(rows, keys).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")


_D3_SQL = f"""WITH {STORED}
SELECT id, link, site_name FROM stored
UNION ALL SELECT id, link, site_name FROM it WHERE link NOT IN (SELECT link FROM stored)"""


@query("d3_insert_ignore", _D3_SQL)
def _(spark, sf):
    return D.insert_ignore(items_stored(spark, sf), items_all(spark, sf)).select("id", "link", "site_name")


def _keyed(rows, key):
    """``rows`` as a stored table in a folder of its own."""
    name = f"keyed_{uuid.uuid4().hex}"
    return KeyedTable(rows.sparkSession, name, f"{ensure_checkpoint_dir(rows.sparkSession)}/{name}", rows.schema, key, 8, 8
                      ).declare().replace(rows)


@query("d3_merge_stored", _D3_SQL)
def _(spark, sf):
    stored = _keyed(items_stored(spark, sf), "link")
    merge_items(stored, items_all(spark, sf))
    return stored.read().select("id", "link", "site_name")


_STALE = f"""(try_strptime(pub_date, '%Y-%m-%dT%H:%M:%SZ') IS NOT NULL
  AND try_strptime(pub_date, '%Y-%m-%dT%H:%M:%SZ') <= TIMESTAMP '{NOW}' - to_days(7))"""


@query("d4_fresh_items", f"WITH {ITEMS_ALL} SELECT id, pub_date FROM it_all WHERE NOT {_STALE}")
def _(spark, sf):
    return D.fresh_items(items_all(spark, sf), 7, NOW).select("id", "pub_date")


@query("d4_fresh_items_disabled", f"WITH {ITEMS_ALL} SELECT id, pub_date FROM it_all")
def _(spark, sf):
    return D.fresh_items(items_all(spark, sf), 0, NOW).select("id", "pub_date")


@query("d5_ingest_counters", f"""WITH {STORED},
n AS (SELECT *, {_STALE} AS old FROM it WHERE link NOT IN (SELECT link FROM stored))
SELECT f.site_name, f.fetched, count(n.id) AS new, count(n.id) FILTER (WHERE n.old) AS stale,
  count(n.id) FILTER (WHERE NOT n.old) AS fresh
FROM (SELECT site_name, count(*) AS fetched FROM it_all GROUP BY 1) f LEFT JOIN n ON n.site_name = f.site_name
GROUP BY 1, 2""")
def _(spark, sf):
    return D.ingest_counters(items_all(spark, sf), items_stored(spark, sf), 7, NOW)


@query("d6_exists_link", f"""WITH {STORED}
SELECT id, link, link IN (SELECT link FROM stored) AS is_stored FROM it_all""")
def _(spark, sf):
    return D.exists_link(items_stored(spark, sf), items_all(spark, sf).select("id", "link"))


@query("d7_pending_analysis", f"WITH {ANALYSIS} SELECT id, title FROM it WHERE id NOT IN (SELECT item_id FROM an)")
def _(spark, sf):
    return D.pending_analysis(items_unique(spark, sf), analysis_unique(spark, sf)).select("id", "title")


# ── stored queries ────────────────────────────────────────────────────────────────────
_BETWEEN = f"created_at >= TIMESTAMP '{SINCE}' AND created_at <= TIMESTAMP '{UNTIL}'"


@query("q1_list_items", f"""WITH {ITEMS}
SELECT id, title, link, {stamp('created_at')} AS created_at FROM it
WHERE site_name = 'press' AND {_BETWEEN} ORDER BY it.created_at DESC, id DESC LIMIT 40""")
def _(spark, sf):
    rows = Q.list_items(items_unique(spark, sf), "press", SINCE, UNTIL, desc=True, limit=40)
    return rows.select("id", "title", "link", "created_at")


@query("q1_list_items_all", f"WITH {ITEMS} SELECT id, site_name, {stamp('created_at')} AS created_at FROM it")
def _(spark, sf):
    return Q.list_items(items_unique(spark, sf)).select("id", "site_name", "created_at")


@query("q2_count_by_source", f"WITH {ITEMS} SELECT site_name, count(*) AS n FROM it WHERE {_BETWEEN} GROUP BY 1")
def _(spark, sf):
    return Q.count_by_source(items_unique(spark, sf), SINCE, UNTIL)


@query("q3_total_count", f"WITH {ITEMS} SELECT count(*) AS n FROM it WHERE {_BETWEEN}")
def _(spark, sf):
    return Q.total_count(items_unique(spark, sf), SINCE, UNTIL)


@query("q4_count_by_source_all", f"WITH {ITEMS} SELECT site_name, count(*) AS n FROM it GROUP BY 1")
def _(spark, sf):
    return Q.count_by_source(items_unique(spark, sf))


_JOINED = f"WITH {ANALYSIS} SELECT it.id, it.title, it.link, it.site_name, an.score, an.category AS ai_category, an.summary"
_LOCAL_DAY = "CAST(it.created_at + to_hours(8) AS DATE)"
_JOIN_COLUMNS = ["id", "title", "link", "site_name", "score", "ai_category", "summary"]


@query("q5_top_scored_day", _JOINED + f""" FROM it JOIN an ON an.item_id = it.id
WHERE {_LOCAL_DAY} = DATE '{DAY}' ORDER BY an.score DESC, it.id LIMIT 20""")
def _(spark, sf):
    from signalsieve.functions.periods import day_bounds, in_range

    # only the day's items are scored
    of_day = items_unique(spark, sf, heavy=True).filter(in_range(c("created_at"), day_bounds(DAY)))
    return Q.top_scored_day(of_day, analysis_of(of_day), DAY).select(*_JOIN_COLUMNS)


@query("q5_top_scored_per_day", _JOINED + f""", CAST({_LOCAL_DAY} AS VARCHAR) AS day,
  CAST(row_number() OVER (PARTITION BY {_LOCAL_DAY} ORDER BY an.score DESC, it.id) AS INTEGER) AS day_rank
FROM it JOIN an ON an.item_id = it.id
QUALIFY row_number() OVER (PARTITION BY {_LOCAL_DAY} ORDER BY an.score DESC, it.id) <= 5""")
def _(spark, sf):
    rows = Q.top_scored_per_day(items_unique(spark, sf), analysis_unique(spark, sf), 5)
    return rows.select(*_JOIN_COLUMNS, "day", "day_rank")


def notified(spark, sf):
    from signalsieve.functions.periods import utc_literal

    return analysis_unique(spark, sf).filter(c("analyzed_at") < utc_literal(NOTIFIED_BEFORE)).select("item_id")


NOTIFIED = ANALYSIS + f""",
notified AS (SELECT item_id FROM an WHERE analyzed_at < TIMESTAMP '{NOTIFIED_BEFORE}')"""


@query("q6_urgent_unnotified", f"""WITH {NOTIFIED}
SELECT it.id, it.title, an.score, {stamp('an.analyzed_at')} AS analyzed_at FROM it JOIN an ON an.item_id = it.id
WHERE an.is_urgent AND an.item_id NOT IN (SELECT item_id FROM notified)""")
def _(spark, sf):
    rows = Q.urgent_unnotified(items_unique(spark, sf), analysis_unique(spark, sf), notified(spark, sf))
    return rows.select("id", "title", "score", "analyzed_at")


@query("q7_mark_notified", f"""WITH {NOTIFIED}
SELECT item_id FROM notified UNION SELECT item_id FROM an WHERE is_urgent""")
def _(spark, sf):
    return Q.mark_notified(notified(spark, sf), analysis_unique(spark, sf).filter("is_urgent"))


@query("q8_export_training", f"""WITH {ANALYSIS}
SELECT it.id AS item_id, it.title, it.content, nullif(it.full_content, '') AS full_content, it.site_name,
  {RESULT_COLUMNS.replace('score, category', 'an.score, an.category')}, an.model_used,
  {stamp('it.created_at')} AS created_at, {stamp('an.analyzed_at')} AS analyzed_at
FROM it JOIN an ON an.item_id = it.id WHERE it.{_BETWEEN.replace('AND created_at', 'AND it.created_at')}""")
def _(spark, sf):
    return Q.export_training(items_unique(spark, sf), analysis_unique(spark, sf), SINCE, UNTIL)


_LABELLED = """
SELECT doc_id AS item_id, CAST(1 + 6 * quality + 2 * toxic AS INTEGER) AS score,
  CASE WHEN toxic = 1 THEN 'malware_distribution' ELSE 'data_trade' END AS category,
  'labels' AS model_used"""
_RELABELLED = ANALYSIS + f""",
fresh_rows AS ({_LABELLED}, TIMESTAMP '2024-02-02 00:00:00' AS analyzed_at FROM labels
  UNION ALL {_LABELLED.replace('1 + 6', '2 + 6')}, TIMESTAMP '2024-02-01 00:00:00' AS analyzed_at FROM labels)"""


def labelled(spark, sf):
    """A second analysis of the labelled documents, in two versions."""
    labels = table(spark, sf, "labels")
    none = F.array().cast("array<string>")

    def version(low: int, day: str):
        return labels.select(
            c("doc_id").alias("item_id"),
            (low + 6 * c("quality") + 2 * c("toxic")).cast("int").alias("score"),
            F.when(c("toxic") == 1, "malware_distribution").otherwise("data_trade").alias("category"),
            none.alias("tags"), F.lit("").alias("summary"), none.alias("affected_targets"),
            F.lit(-1).alias("estimated_records"), none.alias("data_types"), F.lit(False).alias("is_urgent"),
            F.lit("low").alias("confidence_level"), F.lit("").alias("reasoning"),
            F.lit("labels").alias("model_used"), F.lit(day).cast("timestamp").alias("analyzed_at"),
        )

    return version(1, "2024-02-02").unionByName(version(2, "2024-02-01"))


_Q9_SQL = f"""WITH {_RELABELLED}
SELECT item_id, score, category, model_used FROM an WHERE item_id NOT IN (SELECT item_id FROM fresh_rows)
UNION ALL SELECT item_id, score, category, model_used FROM fresh_rows WHERE analyzed_at = TIMESTAMP '2024-02-02 00:00:00'"""


@query("q9_upsert_analysis", _Q9_SQL)
def _(spark, sf):
    rows = Q.upsert_analysis(analysis_unique(spark, sf), labelled(spark, sf))
    return rows.select("item_id", "score", "category", "model_used")


@query("q9_merge_stored", _Q9_SQL)
def _(spark, sf):
    stored = _keyed(analysis_unique(spark, sf), "item_id")
    merge_analysis(stored, labelled(spark, sf))
    return stored.read().select("item_id", "score", "category", "model_used")


@query("q10_denormalize", f"""WITH {ANALYSIS}
SELECT it.id, coalesce(an.score, 0) AS ai_score, coalesce(an.category, '') AS ai_category,
  coalesce(an.is_urgent, false) AS ai_urgent FROM it LEFT JOIN an ON an.item_id = it.id""")
def _(spark, sf):
    rows = Q.denormalize(items_unique(spark, sf), analysis_unique(spark, sf))
    return rows.select("id", "ai_score", "ai_category", "ai_urgent")


@query("q11_get_analysis", f"""WITH {ANALYSIS}
SELECT it_all.id AS item_id, {RESULT_COLUMNS}, {stamp('an.analyzed_at')} AS analyzed_at
FROM it_all LEFT JOIN an ON an.item_id = it_all.id""".replace("category, array", "an.category, array"))
def _(spark, sf):
    ids = items_all(spark, sf).select(c("id").alias("item_id"))
    return Q.get_analysis(ids, analysis_unique(spark, sf)).drop("model_used")


@query("q12_prune", f"""WITH {ANALYSIS},
kept AS (SELECT * FROM it WHERE created_at >= TIMESTAMP '{NOW}' - to_days(10))
SELECT 'item' AS side, id FROM kept
UNION ALL SELECT 'analysis', item_id FROM an WHERE item_id IN (SELECT id FROM kept)
UNION ALL SELECT 'deleted', count(*) FROM it WHERE created_at < TIMESTAMP '{NOW}' - to_days(10)""")
def _(spark, sf):
    out = Q.prune(items_unique(spark, sf), analysis_unique(spark, sf), 10, NOW)
    return (
        out.items.select(F.lit("item").alias("side"), "id")
        .unionByName(out.analysis.select(F.lit("analysis").alias("side"), c("item_id").alias("id")))
        .unionByName(out.deleted.select(F.lit("deleted").alias("side"), c("deleted").alias("id")))
    )


_PAGE = """
SELECT CAST(row_number() OVER (ORDER BY p.created_at DESC, p.id DESC) AS INTEGER) AS page_row, p.id, p.title, p.link,
  p.pub_date, p.author, p.category,
  CASE WHEN length(p.content) > 300 THEN substr(p.content, 1, 300) || '…' ELSE p.content END AS content,
  array_to_string(p.download_links, '|') AS download_links, p.site_name, strftime(p.created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
  coalesce(an.score, 0) AS ai_score, coalesce(an.category, '') AS ai_category, coalesce(an.is_urgent, false) AS ai_urgent,
  coalesce(an.summary, '') AS ai_summary, (SELECT count(*) > 50 FROM more) AS has_more,
  (SELECT CASE WHEN count(*) > 50 THEN strftime((SELECT created_at FROM more ORDER BY created_at DESC, id DESC LIMIT 1 OFFSET 49),
     '%Y-%m-%d %H:%M:%S') END FROM more) AS next_created_at,
  (SELECT CASE WHEN count(*) > 50 THEN (SELECT id FROM more ORDER BY created_at DESC, id DESC LIMIT 1 OFFSET 49) END FROM more) AS next_id
FROM (SELECT * FROM more ORDER BY created_at DESC, id DESC LIMIT 50) p LEFT JOIN an ON an.item_id = p.id"""


@query("q13_page_items", f"WITH {ANALYSIS}, more AS (SELECT * FROM it ORDER BY created_at DESC, id DESC LIMIT 51) {_PAGE}")
def _(spark, sf):
    return Q.page_items(items_unique(spark, sf), analysis_unique(spark, sf))


@query("q13_page_items_next", f"""WITH {ANALYSIS}, more AS (SELECT * FROM it WHERE site_name = 'board'
  AND (created_at, id) < (TIMESTAMP '2024-01-14 14:00:00', 407) ORDER BY created_at DESC, id DESC LIMIT 51) {_PAGE}""")
def _(spark, sf):
    at = Q.Cursor(datetime(2024, 1, 14, 14), 407)
    return Q.page_items(items_unique(spark, sf), analysis_unique(spark, sf), "board", at)


_TODAY = f"CAST(created_at + to_hours(8) AS DATE) = CAST(TIMESTAMP '{NOW}' + to_hours(8) AS DATE)"


@query("q14_stats", f"""WITH {ITEMS}
SELECT 'source' AS scope, site_name, count(*) AS total_count, count(*) FILTER (WHERE {_TODAY}) AS today_count FROM it GROUP BY 2
UNION ALL SELECT 'all', '', count(*), count(*) FILTER (WHERE {_TODAY}) FROM it""")
def _(spark, sf):
    return Q.stats(items_unique(spark, sf), NOW)


WEEK_SQL = f"""
SELECT CAST(d.day AS VARCHAR) AS day, strftime(d.day, '%m/%d') AS label, count(x.created_at) AS n
FROM (SELECT CAST(CAST(TIMESTAMP '{NOW}' + to_hours(8) AS DATE) - to_days(CAST(i AS INTEGER)) AS DATE) AS day
      FROM range(7) r(i)) d
LEFT JOIN x ON CAST(x.created_at + to_hours(8) AS DATE) = d.day GROUP BY d.day"""


@query("q15_last_7_days", f"WITH {ITEMS}, x AS (SELECT created_at FROM it) {WEEK_SQL}")
def _(spark, sf):
    return Q.last_7_days(items_unique(spark, sf), NOW)


@query("q15_last_7_days_events", f"WITH x AS (SELECT date_trunc('second', ts) AS created_at FROM events) {WEEK_SQL}")
def _(spark, sf):
    return Q.last_7_days(event_items(table(spark, sf, "events")), NOW)


@query("q16_search_items", f"""WITH {ANALYSIS}
SELECT it.id, it.title, an.score AS ai_score FROM it LEFT JOIN an ON an.item_id = it.id
WHERE contains(lower(it.title || it.site_name || coalesce(an.category, '') || coalesce(an.summary, '')), 'financial')
  AND coalesce(an.score, 0) >= 5 AND it.site_name = 'cardforum'""")
def _(spark, sf):
    rows = Q.with_analysis(items_unique(spark, sf), analysis_unique(spark, sf), "left").withColumnsRenamed(
        {"score": "ai_score", "summary": "ai_summary"}
    )
    return Q.search_items(rows, "Financial", "cardforum", 5).select("id", "title", "ai_score")


@query("q17_source_facets", f"WITH {ITEMS} SELECT site_name, count(*) AS n FROM it GROUP BY 1")
def _(spark, sf):
    return Q.source_facets(items_unique(spark, sf))


@query("q17_source_facets_by_name", "SELECT l_returnflag || l_linestatus AS site_name, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("site_name"))
    return Q.source_facets(rows, by="name")
