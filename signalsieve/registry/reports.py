"""Queries of the report and alert operators."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from signalsieve.operators import alerts as N
from signalsieve.operators.store import with_analysis
from signalsieve.functions.periods import utc_literal
from signalsieve.plans import reports as P
from signalsieve.registry.base import ANALYSIS, ITEMS, any_in, q, query, stamp
from signalsieve.registry.store import DAY, NOTIFIED, WEEK_SQL, notified
from signalsieve.registry.views import NOW, analysis_unique, items_unique, table
from signalsieve.functions import fixed_values as fv
from signalsieve.session import ensure_checkpoint_dir

c = F.col
UPDATED = datetime(2024, 1, 20, 12, 0, 0)
SITE_URL = "https://example.org/reports"
_D = "CAST(CAST(created_at + to_hours(8) AS DATE) AS VARCHAR)"
_MONDAY = "CAST(date_trunc('week', created_at + to_hours(8)) AS DATE)"
_W = f"CAST({_MONDAY} AS VARCHAR) || '_' || CAST(CAST({_MONDAY} + to_days(6) AS DATE) AS VARCHAR)"


def _counts_sql(period: str) -> str:
    return f"""WITH {ITEMS}
SELECT period, site_name, n, CAST(sum(n) OVER (PARTITION BY period) AS BIGINT) AS total
FROM (SELECT {period} AS period, site_name, count(*) AS n FROM it GROUP BY 1, 2) x"""


def _items_sql(period: str) -> str:
    return f"WITH {ITEMS} SELECT {period} AS period, id, title, {stamp('created_at')} AS created_at FROM it"


def _counts(rep: P.Report):
    # one row per period and source by now
    total = F.sum("n").over(Window.partitionBy("period"))
    return rep.by_source.withColumn("total", total)


def _of(rep: P.Report):
    return rep.items.select("period", "id", "title", "created_at")


@query("p1_daily_report", _counts_sql(_D))
def _(spark, sf):
    return _counts(P.daily_report(items_unique(spark, sf)))


@query("p1_daily_report_items", _items_sql(_D))
def _(spark, sf):
    return _of(P.daily_report(items_unique(spark, sf)))


@query("p1_daily_report_one_day", _items_sql(_D) + f" WHERE CAST(created_at + to_hours(8) AS DATE) = DATE '{DAY}'"
       .replace("created_at +", "it.created_at +"))
def _(spark, sf):
    return _of(P.daily_report(items_unique(spark, sf), DAY))


@query("p2_weekly_report", _counts_sql(_W))
def _(spark, sf):
    return _counts(P.weekly_report(items_unique(spark, sf)))


@query("p2_weekly_report_items", _items_sql(_W))
def _(spark, sf):
    return _of(P.weekly_report(items_unique(spark, sf)))


@query("p3_alltime_report", _counts_sql("'all'"))
def _(spark, sf):
    return _counts(P.alltime_report(items_unique(spark, sf)))


@query("p3_alltime_report_items", _items_sql("'all'"))
def _(spark, sf):
    return _of(P.alltime_report(items_unique(spark, sf)))


def _markdown_sql(period: str, title: str, stats: str, detail: str) -> str:
    shown = "replace(period, '_', ' – ')"
    return f"""WITH {ITEMS},
x AS (SELECT {period} AS period, * FROM it),
s AS (SELECT period, site_name, count(*) AS n FROM x GROUP BY 1, 2),
t AS (SELECT period, count(*) AS n FROM x GROUP BY 1),
l AS (SELECT chr(10) AS nl)
SELECT period, CAST(0 AS INTEGER) AS section, CAST(0 AS BIGINT) AS neg_n, '' AS site_name, CAST(0 AS BIGINT) AS neg_second,
  CAST(0 AS BIGINT) AS neg_id, '# {title} ' || {shown} || nl || nl || '**' || n || '** items collected' || nl || nl
  || 'Last updated: {UPDATED}' || nl || nl || '{stats}' || nl || nl || '### By source' || nl AS block FROM t, l
UNION ALL SELECT period, 1, -n, site_name, 0, 0, '- ' || site_name || ': ' || n FROM s
UNION ALL SELECT period, 2, 0, '', 0, 0, nl || '{detail}' || nl FROM t, l
UNION ALL SELECT period, 3, 0, '', -CAST(epoch(created_at) AS BIGINT), -id, '### [' || title || '](' || link || ')' || nl || nl
  || '- **Source**: ' || site_name || nl || '- **Found at**: ' || {stamp('created_at')} || nl FROM x, l
UNION ALL SELECT period, 4, 0, '', 0, 0, nl || '---' || nl || nl || 'Generated by signalsieve' FROM t, l"""


@query("p4_report_markdown", _markdown_sql(_D, "Daily leak report", "## Today in numbers", "## Today in detail"))
def _(spark, sf):
    return P.report_markdown(items_unique(spark, sf), P.DAILY, UPDATED)


@query("p4_report_markdown_weekly",
       _markdown_sql(_W, "Weekly leak report", "## This week in numbers", "## This week in detail"))
def _(spark, sf):
    return P.report_markdown(items_unique(spark, sf), P.WEEKLY, UPDATED)


def _esc(e: str) -> str:
    return (f"replace(replace(replace(replace(replace({e}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
            f"'\"', '&#34;'), '''', '&#39;')")


_HEAD = ('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" '
         'xmlns:content="http://purl.org/rss/1.0/modules/content/">')


_RSS_SQL = f"""WITH {ITEMS},
x AS (SELECT {_D} AS period, * FROM it), t AS (SELECT DISTINCT period FROM x), l AS (SELECT chr(10) AS nl)
SELECT period, CAST(0 AS INTEGER) AS section, CAST(0 AS BIGINT) AS neg_second, CAST(0 AS BIGINT) AS neg_id,
  {q(_HEAD)} || nl || '<channel>' || nl || '<title>Daily leak feed ' || period || '</title>' || nl
  || '<link>{SITE_URL}</link>' || nl || '<description>Leak items of ' || period || '</description>' || nl
  || '<pubDate>Sat, 20 Jan 2024 12:00:00 +0000</pubDate>' || nl AS block FROM t, l
UNION ALL SELECT period, 3, -CAST(epoch(created_at) AS BIGINT), -id, '<item>' || nl || '<title>' || {_esc('title')} || '</title>' || nl
  || '<link>' || {_esc('link')} || '</link>' || nl || '<description>'
  || {_esc("CASE WHEN full_content <> '' THEN full_content ELSE content END")} || '</description>' || nl
  || '<guid>' || {_esc("link || '_' || strftime(created_at, '%Y%m%d%H%M%S')")} || '</guid>' || nl
  || '<pubDate>' || strftime(created_at, '%a, %d %b %Y %H:%M:%S +0000') || '</pubDate>' || nl || '</item>' FROM x, l
UNION ALL SELECT period, 4, 0, 0, '</channel>' || nl || '</rss>' FROM t, l"""


@query("p5_report_rss", _RSS_SQL)
def _(spark, sf):
    rows = P.report_rss(items_unique(spark, sf), P.DAILY, SITE_URL, UPDATED)
    return rows.select("period", "section", "neg_second", "neg_id", "block")


@query("p5_report_rss_files", f"""WITH b AS ({_RSS_SQL}),
f AS (SELECT 'daily_rss_' || period || '.xml' AS file, block FROM b
  UNION ALL SELECT 'latest_daily_rss.xml', block FROM b WHERE period = (SELECT max(period) FROM b)),
z AS (SELECT file, CAST(sum(strlen(block) + 1) AS BIGINT) AS n_bytes FROM f GROUP BY 1),
s AS (SELECT file, unnest(string_split(block, chr(10))) AS line FROM f)
SELECT file, any_value(n_bytes) AS n_bytes, count(*) AS n_lines, CAST(count(*) FILTER (line = '<item>') AS BIGINT) AS n_items,
  CAST(sum(CAST('0x' || substr(md5(line), 1, 8) AS BIGINT)) AS BIGINT) AS line_digests
FROM s JOIN z USING (file) GROUP BY 1""")
def _(spark, sf):
    folder = f"{ensure_checkpoint_dir(spark)}/rss-{uuid.uuid4().hex}"
    P.write_rss_files(P.report_rss(items_unique(spark, sf), P.DAILY, SITE_URL, UPDATED), folder, P.DAILY)
    lines = spark.read.option("lineSep", "\n").text(folder).select(
        c("_metadata.file_name").alias("file"), c("_metadata.file_size").alias("size"), "value")
    digest = F.conv(F.substring(F.md5("value"), 1, 8), 16, 10).cast("long")
    return lines.groupBy("file").agg(
        F.max("size").alias("n_bytes"), F.count(F.lit(1)).alias("n_lines"),
        F.count_if(c("value") == "<item>").alias("n_items"), F.sum(digest).alias("line_digests"))


@query("p6_source_distribution", f"""WITH {ITEMS}, s AS (SELECT site_name, count(*) AS n FROM it GROUP BY 1)
SELECT site_name, n, round(greatest(n * 100.0::DOUBLE / (SELECT max(n) FROM s), 1.5), 4) AS percent FROM s""")
def _(spark, sf):
    return P.source_distribution(P.alltime_report(items_unique(spark, sf)).by_source.select("site_name", "n"))


@query("p7_source_headline", """WITH s AS (SELECT source AS site_name, count(*) AS n FROM documents GROUP BY 1)
SELECT count(*) AS sources, (SELECT site_name FROM s ORDER BY n DESC, site_name LIMIT 1) AS top_source, max(n) AS top_count FROM s""")
def _(spark, sf):
    counts = table(spark, sf, "documents").groupBy(c("source").alias("site_name")).agg(F.count(F.lit(1)).alias("n"))
    return P.source_headline(counts)


@query("p8_report_table", f"""WITH {ITEMS}
SELECT id, title, link, site_name, {stamp('created_at')} AS created_at, row_number, CAST(ceil(row_number / 50.0) AS BIGINT) AS page
FROM (SELECT *, row_number() OVER (ORDER BY lower(title) DESC, created_at DESC, id DESC) AS row_number FROM it
      WHERE contains(lower(title), 'data') OR contains(lower(content), 'data')) x""")
def _(spark, sf):
    return P.report_table(items_unique(spark, sf), q=" DATA ", sort="title", asc=False)


@query("p8_report_table_source", f"""WITH {ITEMS}
SELECT id, title, link, site_name, {stamp('created_at')} AS created_at, row_number, CAST(ceil(row_number / 50.0) AS BIGINT) AS page
FROM (SELECT *, row_number() OVER (ORDER BY created_at, id DESC) AS row_number FROM it WHERE site_name = 'press') x""")
def _(spark, sf):
    return P.report_table(items_unique(spark, sf), src="press", sort="time")


def _paged(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/paged-{uuid.uuid4().hex}"


@query("p8_report_page", f"""WITH {ITEMS}
SELECT id, title, link, site_name, {stamp('created_at')} AS created_at, row_number, CAST(2 AS BIGINT) AS page
FROM (SELECT *, row_number() OVER (ORDER BY lower(title), created_at DESC, id DESC) AS row_number FROM it) x
WHERE row_number BETWEEN 51 AND 100""")
def _(spark, sf):
    path = _paged(spark)
    P.write_report_table(items_unique(spark, sf), path, sort="title")
    return P.report_page(spark, path, 2)


@query("p8_report_stored", f"""WITH {ITEMS}
SELECT id, title, link, site_name, {stamp('created_at')} AS created_at, row_number, CAST(ceil(row_number / 50.0) AS BIGINT) AS page
FROM (SELECT *, row_number() OVER (ORDER BY lower(site_name), created_at DESC, id DESC) AS row_number FROM it) x""")
def _(spark, sf):
    path = _paged(spark)
    P.write_report_table(items_unique(spark, sf), path, sort="source")
    return P.report_pages(spark, path)


_TOP = f"""(SELECT row_number() OVER (ORDER BY an.score DESC, it.id) AS rank, an.score, it.title, an.summary, it.link
  FROM it JOIN an ON an.item_id = it.id WHERE CAST(it.created_at + to_hours(8) AS DATE) = DATE '{DAY}'
  QUALIFY row_number() OVER (ORDER BY an.score DESC, it.id) <= 20)"""
LINE = ("(chr(10) || rank || '. [' || score || '/10] ' || title || chr(10) || '   ' || summary || chr(10) || '   ' || link)")


@query("p9_topn_digest", f"WITH {ANALYSIS} SELECT CAST(rank AS INTEGER) AS rank, {LINE} AS line FROM {_TOP} t")
def _(spark, sf):
    return P.topn_digest(items_unique(spark, sf), analysis_unique(spark, sf), DAY).select("rank", "line")


@query("p10_activity_share", f"""WITH {ITEMS}, x AS (SELECT created_at FROM it), w AS ({WEEK_SQL})
SELECT day, label, n, round(n::DOUBLE / greatest(max(n) OVER (), 1), 6) AS share FROM w""")
def _(spark, sf):
    return P.activity_share(items_unique(spark, sf), NOW)


@query("p11_report_table_rows", f"""WITH {ITEMS}
SELECT id, title, link, site_name, {stamp('created_at')} AS created_at,
  CASE WHEN content <> '' THEN CASE WHEN length(content) > 64 THEN substr(content, 1, 64) || '…' ELSE content END END AS preview,
  CASE {' '.join(f"WHEN {any_in('lower(site_name)', w)} THEN '{n}'" for n, w in fv.SITE_BADGES)} ELSE 't4' END AS badge,
  strftime(it.created_at, '%m-%d %H:%M') AS time_label, row_number() OVER (ORDER BY it.created_at DESC, id DESC) AS row_number
FROM it""")
def _(spark, sf):
    return P.report_table_rows(items_unique(spark, sf))


@query("p11_report_rows_page", f"""WITH {ITEMS}
SELECT id, title, link, site_name, strftime(created_at, '%m-%d %H:%M') AS time_label, row_number, CAST(3 AS BIGINT) AS page
FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS row_number FROM it) x
WHERE row_number BETWEEN 101 AND 150""")
def _(spark, sf):
    path = _paged(spark)
    P.write_report_table_rows(items_unique(spark, sf), path)
    return P.report_page(spark, path, 3).select("id", "title", "link", "site_name", "time_label", "row_number", "page")


# ── alerts ────────────────────────────────────────────────────────────────────────────
_ALERT = """an.item_id, {title} AS title, an.summary AS body, it.link, it.site_name, {kind} AS kind, an.score, an.category,
  an.summary, an.affected_targets, an.data_types, an.estimated_records, an.is_urgent, an.confidence_level"""
_ALERTS = ANALYSIS + f""",
al AS (SELECT {_ALERT.format(title='it.title', kind="CASE WHEN an.is_urgent THEN 'urgent' ELSE 'normal' END")}
  FROM it JOIN an ON an.item_id = it.id WHERE an.score >= 5)"""
_SHOWN = "* REPLACE (array_to_string(affected_targets, '|') AS affected_targets, array_to_string(data_types, '|') AS data_types)"
CHANNELS = (
    N.Channel("mobile", "rich"),
    N.Channel("team", "markdown"),
    N.Channel("plain", "text"),
    N.Channel("board", "embed", send_normal=False),
    N.Channel("off", "text", enabled=False),
)


def _alerts(spark, sf):
    return N.select_alerts(with_analysis(items_unique(spark, sf), analysis_unique(spark, sf)))


@query("n1_select_alerts", f"WITH {_ALERTS} SELECT {_SHOWN} FROM al")
def _(spark, sf):
    return _alerts(spark, sf)


@query("n1_notified_ids", f"WITH {_ALERTS} SELECT DISTINCT item_id FROM al WHERE kind = 'urgent'")
def _(spark, sf):
    return N.notified_ids(_alerts(spark, sf))


@query("n2_pending_urgent_outbox", f"""WITH {NOTIFIED},
al AS (SELECT {_ALERT.format(title="'[' || it.site_name || '] ' || it.title", kind="'urgent'")} FROM it JOIN an ON an.item_id = it.id
  WHERE an.is_urgent AND an.item_id NOT IN (SELECT item_id FROM notified))
SELECT {_SHOWN} FROM al""")
def _(spark, sf):
    return N.pending_urgent_outbox(items_unique(spark, sf), analysis_unique(spark, sf), notified(spark, sf))


@query("n3_route_channels", f"""WITH {_ALERTS}
SELECT item_id, kind, channel, layout FROM al JOIN (VALUES ('mobile', 'rich'), ('team', 'markdown'), ('plain', 'text'),
  ('board', 'embed')) ch(channel, layout) ON NOT (channel = 'board' AND kind = 'normal')""")
def _(spark, sf):
    return N.route_channels(_alerts(spark, sf), CHANNELS).select("item_id", "kind", "channel", "layout")


def _md(e: str) -> str:
    return rf"regexp_replace({e}, '([_*\[\]()~`>#+\-=|{{}}.!])', '\\\1', 'g')"


_RICH = f"""(CASE WHEN score >= 9 THEN '🔴' WHEN score >= 7 THEN '🟠' WHEN score >= 5 THEN '🟡' ELSE '🔵' END
  || ' *\\[' || score || '/10\\]* `' || {_md('category')} || '`' || CASE WHEN is_urgent THEN ' ⚠️ *URGENT*' ELSE '' END || chr(10)
  || repeat('━', 20) || chr(10) || '📄 *' || {_md('title')} || '*' || chr(10) || '📌 Source: `' || {_md('site_name')} || '`' || chr(10)
  || CASE WHEN len(affected_targets) > 0 THEN '🎯 Targets: ' || {_md("array_to_string(affected_targets, ', ')")} || chr(10) ELSE '' END
  || CASE WHEN len(data_types) > 0 THEN '📦 Types: ' || {_md("array_to_string(data_types, ' · ')")} || chr(10) ELSE '' END
  || CASE WHEN estimated_records > 0 THEN '📊 Size: ≈' || format('{{:,}}', estimated_records) || ' records' || chr(10) ELSE '' END
  || CASE WHEN summary <> '' THEN '🤖 ' || {_md('summary')} || chr(10) ELSE '' END
  || CASE WHEN link <> '' THEN '🔗 [Open post](' || replace(replace(link, '\\', '\\\\'), ')', '\\)') || ')' ELSE '' END)"""


@query("n4_render_rich", f"WITH {_ALERTS} SELECT item_id, {_RICH} AS text FROM al")
def _(spark, sf):
    return _alerts(spark, sf).select("item_id", N.render_rich().alias("text"))


@query("n5_render_plain", f"""WITH {_ALERTS}
SELECT item_id, '**' || title || '**' || chr(10) || body || chr(10) || 'Link: ' || link AS markdown,
  title || chr(10) || body || chr(10) || 'Link: ' || link AS text, {_RICH} AS rich FROM al""")
def _(spark, sf):
    return _alerts(spark, sf).select(
        "item_id", *[N.render_plain(n).alias(n) for n in ("markdown", "text", "rich")]
    )


@query("n6_render_embed", f"""WITH {_ALERTS}
SELECT item_id, CAST(to_json({{embeds: [{{title: title}}]}}) AS VARCHAR) AS head, '{{"name":"Source","value":"' || site_name || '","inline":true}}' AS site_field,
  CASE WHEN kind = 'urgent' THEN 15548997 ELSE 10233776 END AS color, kind = 'urgent' AS described FROM al""")
def _(spark, sf):
    payload = N.render_embed(utc_literal(UPDATED))
    parsed = F.from_json(
        payload,
        "embeds array<struct<title string, description string, color int, "
        "fields array<struct<name string, value string, inline boolean>>>>",
    )
    rows = _alerts(spark, sf).select("item_id", F.get(parsed["embeds"], F.lit(0)).alias("e"))
    return rows.select(
        "item_id",
        F.to_json(F.struct(F.array(F.struct(c("e.title").alias("title"))).alias("embeds"))).alias("head"),
        F.to_json(F.get("e.fields", F.lit(0))).alias("site_field"),
        c("e.color").alias("color"),
        c("e.description").isNotNull().alias("described"),
    )


@query("n6_render_embed_payload")
def _(spark, sf):
    return _alerts(spark, sf).select("item_id", N.render_embed(utc_literal(UPDATED)).alias("payload"))


@query("n7_report_notice", f"""WITH {ANALYSIS}, t AS (SELECT {_D.replace('created_at', 'it.created_at')} AS period, count(*) AS n FROM it GROUP BY 1),
d AS (SELECT '{DAY}' AS period, chr(10) || chr(10) || '📊 Today''s top ' || count(*) || ':' || chr(10)
  || string_agg({LINE}, '' ORDER BY rank) AS digest FROM {_TOP} x)
SELECT t.period, 'Daily leak report ' || t.period AS title, n || ' leak items collected' || coalesce(digest, '') AS body, 'daily' AS kind
FROM t LEFT JOIN d ON d.period = t.period""")
def _(spark, sf):
    items = items_unique(spark, sf)
    digest = P.digest_text(P.topn_digest(items, analysis_unique(spark, sf), DAY))
    return N.report_notice(P.daily_report(items).totals, N.DAILY, digest)
