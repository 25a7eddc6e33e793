"""Queries of the feed, victim-list, page and source-catalogue operators.

Payloads, directory lines and outlines are built by Spark from the given tables, one per
row, so every query grows with them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from signalsieve.functions import fixed_values as fv
from signalsieve.functions.text import normalize_key, sanitize_name
from signalsieve.operators import catalog as C
from signalsieve.registry.base import any_in, query, sql_list
from signalsieve.registry.views import table
from signalsieve.sources import directories as DIR
from signalsieve.sources import victims as V
from signalsieve.sources.feeds import scan_feed_xml
from signalsieve.sources.pages import page_main_text
from signalsieve.sources.tables import spread

c, lit = F.col, F.lit


def _xml(col):
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        col = F.replace(col, lit(raw), lit(safe))
    return col


def _clean(col):
    # characters that XML does not allow
    return F.regexp_replace(col, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def feed_payloads(spark, sf):
    """One feed document per row of ``documents``: RSS for even ids, Atom for odd ones, each
    with one full entry, one without a link, and one whose title has a bracket."""
    d = c("doc_id").cast("string")
    body = _xml(F.concat(lit("<p>"), _clean(c("text")), lit("</p> https://files.example.org/"), d, lit(".zip, end")))
    rss = F.concat(
        lit('<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>'
            "<title>feed</title><item><title> Post "), d, lit(" </title><link> https://example.org/p/"), d,
        lit("</link><description>"), body, lit("</description><category>"), c("lang"),
        lit("</category><category></category><category>"), c("source"),
        lit("</category><author>me@example.org (Ann "), d,
        lit(")</author><pubDate>Tue, 02 Jan 2024 10:00:00 +0200</pubDate></item><item><title>No link</title></item>"
            "<item><title>[GROUP] "), d, lit("</title><link>https://example.org/g/"), d,
        lit("</link><content:encoded>short</content:encoded><pubDate>never</pubDate></item></channel></rss>"),
    )
    atom = F.concat(
        lit('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>feed</title><entry><title>Post '), d,
        lit('</title><link rel="self" href="https://example.org/self"/><link rel="alternate" href="https://example.org/p/'), d,
        lit('"/><updated>2024-01-02T09:00:00+01:00</updated><author><name>Ann '), d,
        lit('</name></author><category term="'), c("lang"), lit('"/><content type="html">'), body,
        lit("</content></entry><entry><title></title><link href=\"https://example.org/none\"/></entry></feed>"),
    )
    return spread(table(spark, sf, "documents")).select(
        c("source").alias("site_name"), F.when(c("doc_id") % 2 == 0, rss).otherwise(atom).alias("xml")
    )


_PLAIN = r"""regexp_replace(regexp_replace(regexp_replace('<p>' || regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')
  || '</p> https://files.example.org/' || doc_id || '.zip, end', '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"""
_FILE = "'https://files.example.org/' || doc_id || '.zip'"


@query("s1_scan_feed_xml", f"""
SELECT '[' || source || '] Post ' || doc_id AS title, 'https://example.org/p/' || doc_id AS link, '2024-01-02T08:00:00Z' AS pub_date,
  'Ann ' || doc_id AS author, CASE WHEN doc_id % 2 = 0 THEN lang || ', ' || source ELSE lang END AS category,
  {_PLAIN} AS content, '' AS full_content, {_FILE} AS download_links, source AS site_name, CAST(0 AS INTEGER) AS position
FROM documents
UNION ALL SELECT '[GROUP] ' || doc_id, 'https://example.org/g/' || doc_id, '', '', '', 'short', '', '', source, 2
FROM documents WHERE doc_id % 2 = 0""")
def _(spark, sf):
    return scan_feed_xml(feed_payloads(spark, sf))


def _victims(spark, sf, *records):
    """One JSON array per document with the given records."""
    names = [F.struct(*[v.alias(k) for k, v in r.items()]) for r in records]
    return table(spark, sf, "documents").select(
        c("source").alias("site_name"), F.to_json(F.array(*names), {"ignoreNullFields": "false"}).alias("json")
    )


_EMPTY_ARRAY = "'' AS download_links, source AS site_name"


@query("s2_scan_victims_live", f"""
SELECT '[' || upper('g' || lang) || '] Victim ' || doc_id || CASE WHEN lang = 'en' THEN '' ELSE ' (' || lang || ')' END AS title,
  CASE WHEN doc_id % 3 = 0 THEN '{fv.VICTIMS_LIVE_LINK}' ELSE 'https://example.org/c/' || doc_id END AS link, '2024-01-03' AS pub_date,
  '' AS author, 'ransomware' AS category, CASE WHEN doc_id % 2 = 0 THEN '[retail] ' || text ELSE text END AS content,
  '' AS full_content, {_EMPTY_ARRAY}, CAST(0 AS INTEGER) AS position FROM documents""")
def _(spark, sf):
    d = c("doc_id")
    return V.scan_victims_live(_victims(spark, sf, {
        "victim": F.concat(lit("Victim "), d.cast("string")), "group": F.concat(lit("g"), c("lang")),
        "attackdate": lit("2024-01-03"),
        "claim_url": F.when(d % 3 == 0, "").otherwise(F.concat(lit("https://example.org/c/"), d.cast("string"))),
        "description": c("text"), "country": F.when(c("lang") == "en", lit(None)).otherwise(c("lang")),
        "activity": F.when(d % 2 == 0, "retail").otherwise(""),
    }))


@query("s3_scan_victims_look", f"""
SELECT '[' || upper('g ' || lang) || '] Big Corp ' || doc_id AS title,
  CASE WHEN doc_id % 2 = 0 THEN 'https://example.org/l/' || doc_id
       ELSE '{fv.VICTIMS_LOOK_PREFIX}g ' || lang || '#big-corp-' || doc_id END AS link, '2024-01-04' AS pub_date, '' AS author,
  'ransomware' AS category, '[' || lang || '] ' || text AS content, '' AS full_content, {_EMPTY_ARRAY}, CAST(0 AS INTEGER) AS position
FROM documents""")
def _(spark, sf):
    d = c("doc_id").cast("string")
    good = {
        "post_title": F.concat(lit("Big Corp "), d), "discovered": lit("2024-01-04"), "description": c("text"),
        "link": F.when(c("doc_id") % 2 == 0, F.concat(lit("https://example.org/l/"), d)),
        "group_name": F.concat(lit("g "), c("lang")), "country": c("lang"),
    }
    return V.scan_victims_look(_victims(spark, sf, good, {**good, "group_name": lit("")}, {**good, "post_title": lit(None).cast("string")}))


@query("s4_scan_victims_watch", f"""
SELECT '[' || upper(lang) || '] Shop ' || doc_id || ' ' || i AS title, '{fv.VICTIMS_WATCH_PREFIX}' || lang || '/shop-' || doc_id || '-' || i AS link,
  '2024-01-05' AS pub_date, '' AS author, 'ransomware' AS category,
  'Ransomware group ' || lang || ' claimed victim: Shop ' || doc_id || ' ' || i AS content, '' AS full_content, {_EMPTY_ARRAY},
  CAST(i AS INTEGER) AS position FROM documents, range(3) r(i)""")
def _(spark, sf):
    d = c("doc_id").cast("string")
    posts = [
        {"post_title": F.concat(lit("Shop "), d, lit(f" {i}")), "group_name": c("lang"), "discovered": lit("2024-01-05")}
        for i in range(3)
    ]
    return V.scan_victims_watch(_victims(spark, sf, *posts))


# the given pages have one article of h1, p, b and br; all else around it is dropped
@query("s6_page_main_text", r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '\s+', ' ', 'g') AS t FROM pages),
m AS (SELECT page_id, url, replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  t, '<h1>', chr(10) || chr(10) || '# ', 'g'), '</?p>|</h1>', chr(10) || chr(10), 'g'), '</?b>', '**', 'g'), '<br>', chr(10), 'g'),
  '&quot;', '"'), '&amp;', '&') AS t FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(
  t, '\*\*\s*\*\*', '', 'g'), '[ \t]*\n[ \t]*', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10)) AS t FROM m)
SELECT page_id, url, nullif(t, '') AS full_content FROM c""")
def _(spark, sf):
    return page_main_text(spread(table(spark, sf, "pages")))


# ── catalogue ─────────────────────────────────────────────────────────────────────────
_KEY = r"lower(replace(replace(replace(replace(replace(regexp_replace({e}, '^\s+|\s+$', '', 'g'), ' ', '_'), '.', '_'), '-', '_'), '(', ''), ')', ''))"
_SOURCES = """
seed AS (SELECT 'Source ' || s_suppkey AS name, 'https://seed.example.org/' || s_suppkey AS rss_url, true AS enabled, s_suppkey AS position FROM supplier),
disc AS (SELECT 'source.' || (c_custkey // 2) AS name, 'https://disc.example.org/' || c_custkey AS rss_url, true AS enabled, c_custkey AS position FROM customer),
loc AS (SELECT 'SOURCE-' || p_partkey AS name, CASE WHEN p_size < 5 THEN '' ELSE 'https://local.example.org/' || p_partkey END AS rss_url,
  p_size % 2 = 0 AS enabled, p_partkey AS position FROM part),
rem AS (SELECT '(Source) ' || o_custkey AS name, CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'https://remote.example.org/' || o_orderkey END AS rss_url,
  o_orderpriority <> '1-URGENT' AS enabled, o_orderkey AS position FROM orders)"""


def _sources(spark, sf):
    def text(prefix, col):
        return F.concat(lit(prefix), col.cast("string"))

    def rows(name, title, url, enabled, position):
        return table(spark, sf, name).select(
            title.alias("name"), url.alias("rss_url"), enabled.alias("enabled"), position.alias("position")
        )

    seed = rows("supplier", text("Source ", c("s_suppkey")), text("https://seed.example.org/", c("s_suppkey")),
                lit(True), c("s_suppkey"))
    disc = rows("customer", text("source.", F.floor(c("c_custkey") / 2)), text("https://disc.example.org/", c("c_custkey")),
                lit(True), c("c_custkey"))
    loc = rows("part", text("SOURCE-", c("p_partkey")),
               F.when(c("p_size") < 5, "").otherwise(text("https://local.example.org/", c("p_partkey"))),
               c("p_size") % 2 == 0, c("p_partkey"))
    rem = rows("orders", text("(Source) ", c("o_custkey")),
               F.when(c("o_orderstatus") == "P", "").otherwise(text("https://remote.example.org/", c("o_orderkey"))),
               c("o_orderpriority") != "1-URGENT", c("o_orderkey"))
    return seed, disc, loc, rem


@query("c1_merge_sources", f"""WITH {_SOURCES},
u AS (SELECT *, 'discovered' AS origin, 0 AS prio, -position AS pos FROM disc UNION ALL SELECT *, 'seed', 1, position FROM seed
  UNION ALL SELECT *, 'local', 2, position FROM loc WHERE rss_url <> '' UNION ALL SELECT *, 'remote', 3, position FROM rem WHERE rss_url <> ''),
k AS (SELECT *, {_KEY.format(e='name')} AS source_key FROM u),
w AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY prio DESC, pos DESC) = 1)
SELECT source_key, name, rss_url, origin FROM w WHERE enabled""")
def _(spark, sf):
    return C.merge_sources(*_sources(spark, sf))


@query("c2_normalize_key", f"""SELECT p_partkey, {_KEY.format(e="' ' || p_name || ' (' || p_brand || ').x-' || p_type || ' '")} AS source_key FROM part""")
def _(spark, sf):
    name = F.concat(lit(" "), "p_name", lit(" ("), "p_brand", lit(").x-"), "p_type", lit(" "))
    return table(spark, sf, "part").select("p_partkey", normalize_key(name).alias("source_key"))


_LONG_NAME = """(c_name || CASE c_nationkey % 4 WHEN 0 THEN ' (Mirror of ' || c_mktsegment || ')' WHEN 1 THEN ' (onion) x (DARK web)'
  WHEN 2 THEN ' (market)' ELSE ' ' END)"""


@query("c3_sanitize_name", rf"""SELECT c_custkey, regexp_replace(regexp_replace({_LONG_NAME},
  '(?i)\s*\((?:deep|dark|mirror|backup|onion)[^)]*\)', '', 'g'), '^\s+|\s+$', '', 'g') AS name FROM customer""")
def _(spark, sf):
    n = c("c_nationkey") % 4
    name = F.concat(
        "c_name",
        F.when(n == 0, F.concat(lit(" (Mirror of "), "c_mktsegment", lit(")"))).when(n == 1, " (onion) x (DARK web)")
        .when(n == 2, " (market)").otherwise(" "),
    )
    return table(spark, sf, "customer").select("c_custkey", sanitize_name(name).alias("name"))


_LINES = """lines AS (SELECT page_id AS line_no, '| [Page ' || page_id || ' (mirror 1)](' || replace(regexp_replace(url, '[?#].*$', ''), 'http:', 'https:')
  || '/) ' || CASE page_id % 4 WHEN 0 THEN 'is ONLINE' WHEN 1 THEN '| ONLINE' WHEN 2 THEN '| OFF' ELSE '' END
  || ' | [b](https://x' || (page_id // 2) || '.onion) ONLINE | [c](https://c' || (page_id // 2) || '.example.org//)| ONLINE |' AS line FROM pages)"""


def _directory(spark, sf):
    p, half = c("page_id"), F.floor(c("page_id") / 2).cast("string")
    url = F.replace(F.regexp_replace("url", "[?#].*$", ""), lit("http:"), lit("https:"))
    state = F.when(p % 4 == 0, "is ONLINE").when(p % 4 == 1, "| ONLINE").when(p % 4 == 2, "| OFF").otherwise("")
    line = F.concat(
        lit("| [Page "), p.cast("string"), lit(" (mirror 1)]("), url, lit("/) "), state, lit(" | [b](https://x"), half,
        lit(".onion) ONLINE | [c](https://c"), half, lit(".example.org//)| ONLINE |"),
    )
    return table(spark, sf, "pages").select(p.alias("line_no"), line.alias("line"))


def _links_sql(pattern: str) -> str:
    clean = r"regexp_replace(n, '(?i)\s*\((?:deep|dark|mirror|backup|onion)[^)]*\)', '', 'g')"
    return rf"""WITH {_LINES},
m AS (SELECT line_no, unnest(regexp_extract_all(line, '{pattern}', 1)) AS n, rtrim(unnest(regexp_extract_all(line, '{pattern}', 2)), '/') AS base,
  unnest(range(len(regexp_extract_all(line, '{pattern}', 1)))) AS ord FROM lines)
SELECT line_no, CAST(ord AS INTEGER) AS ord, {clean} AS name, base FROM m WHERE NOT contains(base, '.onion')
QUALIFY row_number() OVER (PARTITION BY base ORDER BY line_no, ord) = 1"""


@query("c4_directory_links", _links_sql(r"\[([^\]]+)\]\((https://[^)]+)\)[^|]*ONLINE"))
def _(spark, sf):
    return DIR.directory_links(_directory(spark, sf))


@query("c4_directory_links_next_cell", _links_sql(r"\[([^\]]+)\]\((https://[^)]+)\)[^|]*\|\s*ONLINE"))
def _(spark, sf):
    return DIR.directory_links(_directory(spark, sf), mode="next_cell")


_TABLE_LINES = """lines AS (SELECT c_custkey + 1 AS line_no, '| ' || CASE WHEN c_custkey % 3 = 0 THEN 'plain' ELSE '[Group ' || c_custkey || ' (backup)](x)' END
  || ' | https://g' || (c_custkey // 3) || '.example.org/rss.xml | ' || CASE WHEN c_custkey % 5 = 0 THEN 'OFF' ELSE 'ONLINE' END
  || ' | see https://f' || c_custkey || '.example.org/feed/?x=' || c_nationkey || ' and more | http://a' || c_custkey || '.onion/rss |' AS line FROM customer)"""


@query("c5_table_feed_urls", rf"""WITH {_TABLE_LINES},
r AS (SELECT line_no, string_split(line, '|') AS cells FROM lines WHERE line_no > 2 AND contains(line, 'ONLINE')),
e AS (SELECT line_no, trim(regexp_replace(regexp_extract(cells[2], '\[([^\]]+)\]', 1), '(?i)\s*\((?:deep|dark|mirror|backup|onion)[^)]*\)', '', 'g')) AS cell_name,
  unnest(cells) AS cell_text, unnest(range(len(cells))) AS cell FROM r WHERE len(cells) >= 5),
u AS (SELECT *, regexp_extract(cell_text, 'https?://[^\s|<>"]+\.(?:rss|xml|atom)|https?://[^\s|<>"]+/(?:rss|feed|atom)/?(?:[^|\s<>"]*)?') AS rss_url FROM e),
k AS (SELECT * FROM u WHERE rss_url <> '' AND NOT contains(rss_url, '.onion')
  QUALIFY row_number() OVER (PARTITION BY rss_url ORDER BY line_no, cell) = 1)
SELECT CASE WHEN cell_name <> '' THEN cell_name ELSE first_value(rss_url) OVER (PARTITION BY line_no ORDER BY cell) END || ' (ransom)' AS name,
  rss_url, true AS enabled, line_no, CAST(cell AS INTEGER) AS cell FROM k""")
def _(spark, sf):
    k, text = c("c_custkey"), c("c_custkey").cast("string")
    line = F.concat(
        lit("| "), F.when(k % 3 == 0, "plain").otherwise(F.concat(lit("[Group "), text, lit(" (backup)](x)"))),
        lit(" | https://g"), F.floor(k / 3).cast("string"), lit(".example.org/rss.xml | "),
        F.when(k % 5 == 0, "OFF").otherwise("ONLINE"), lit(" | see https://f"), text, lit(".example.org/feed/?x="),
        c("c_nationkey").cast("string"), lit(" and more | http://a"), text, lit(".onion/rss |"),
    )
    return DIR.table_feed_urls(table(spark, sf, "customer").select((k + 1).alias("line_no"), line.alias("line")))


_LABEL = "(c_name || CASE c_nationkey % 3 WHEN 0 THEN ' Data Breach & \"news\"' WHEN 1 THEN ' cooking' ELSE ' paste <bin>' END)"


@query("c6_outline_feeds", f"""
SELECT c_custkey, CAST(1 AS INTEGER) AS position, {_LABEL} AS name, 'https://o.example.org/rss?a=' || c_custkey || '&b=1' AS rss_url, true AS enabled
FROM customer WHERE {any_in(f'lower({_LABEL})', fv.OUTLINE_KEYWORDS)}
UNION ALL SELECT c_custkey, 2, 'quiet', 'https://t.example.org/' || c_custkey, true FROM customer WHERE c_mktsegment = 'BUILDING'""")
def _(spark, sf):
    k, n = c("c_custkey").cast("string"), c("c_nationkey") % 3
    label = F.concat("c_name", F.when(n == 0, ' Data Breach & "news"').when(n == 1, " cooking").otherwise(" paste <bin>"))
    opml = F.concat(
        lit('<opml version="2.0"><body><outline text="Leaked things"><outline text="'), _xml(label),
        lit('" type="rss" xmlUrl="https://o.example.org/rss?a='), k, lit("&amp;b=1\"/><outline text='quiet' title='"),
        c("c_mktsegment"), lit(" "), F.when(c("c_mktsegment") == "BUILDING", "ransomware").otherwise("x > y"),
        lit("' xmlUrl='https://t.example.org/"), k, lit("'></outline></outline></body></opml>"),
    )
    return DIR.outline_feeds(table(spark, sf, "customer").select("c_custkey", opml.alias("opml")))


@query("c7_named_feed_map", """
SELECT 'a' || s_suppkey AS feed_key, s_name AS name, 'https://m.example.org/' || s_suppkey AS rss_url, true AS enabled FROM supplier
UNION ALL SELECT 'b' || s_suppkey, 'https://n.example.org/' || s_suppkey, 'https://n.example.org/' || s_suppkey, true FROM supplier""")
def _(spark, sf):
    k = c("s_suppkey").cast("string")

    def entry(url, name):
        return F.struct(url.alias("rss_url"), name.alias("website_name"))

    feeds = F.create_map(
        F.concat(lit("a"), k), entry(F.concat(lit("https://m.example.org/"), k), c("s_name")),
        F.concat(lit("b"), k), entry(F.concat(lit("https://n.example.org/"), k), lit("")),
        F.concat(lit("c"), k), entry(lit(""), c("s_name")),
    )
    return DIR.named_feed_map(table(spark, sf, "supplier").select(feeds.alias("feeds")))


@query("c8_merge_discovered", f"""WITH {_SOURCES},
u AS (SELECT name, rss_url, position, 0 AS list_rank FROM disc UNION ALL SELECT name, rss_url, position, 1 FROM seed
  UNION ALL SELECT name, rss_url, position, 2 FROM rem)
SELECT *, {_KEY.format(e='name')} AS source_key FROM u
QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY list_rank, position) = 1""")
def _(spark, sf):
    seed, disc, _, rem = _sources(spark, sf)
    return C.merge_discovered([disc, seed, rem])


_CANDIDATES = f"""cand AS (SELECT s_name AS name, 'https://b' || s_suppkey || '.example.org' AS base, CAST(i - 1 AS INTEGER) AS path_ord,
  {sql_list(fv.FEED_PATHS)}[i] AS path, 'https://b' || s_suppkey || '.example.org' || {sql_list(fv.FEED_PATHS)}[i] AS url
  FROM supplier, range(1, 10) r(i))"""
_PROBES = _CANDIDATES + """,
probes AS (SELECT url, CAST(CASE WHEN (length(url) + ascii(substr(base, 10))) % 3 = 0 THEN 200 ELSE 404 END AS INTEGER) AS status,
  CASE WHEN path_ord % 2 = 0 THEN '<?xml version="1.0"?><rss>' ELSE '<html>' END AS body FROM cand)"""


def _candidates(spark, sf):
    k = c("s_suppkey").cast("string")
    bases = table(spark, sf, "supplier").select(
        c("s_name").alias("name"), F.concat(lit("https://b"), k, lit(".example.org")).alias("base")
    )
    return C.probe_candidates(bases)


def _probes(candidates):
    odd = (F.char_length("url") + F.ascii(F.substr("base", lit(10)))) % 3 == 0
    return candidates.select(
        "url", F.when(odd, 200).otherwise(404).alias("status"),
        F.when(c("path_ord") % 2 == 0, '<?xml version="1.0"?><rss>').otherwise("<html>").alias("body"),
    )


@query("c9_probe_candidates", f"WITH {_CANDIDATES} SELECT * FROM cand")
def _(spark, sf):
    return _candidates(spark, sf)


_FEED_MARK = any_in("body", fv.FEED_MARKERS)


@query("c10_first_live_endpoint", f"""WITH {_PROBES}
SELECT name, base, arg_min(url, path_ord) AS rss_url FROM cand
WHERE url IN (SELECT url FROM probes WHERE status < 400 AND {_FEED_MARK}) GROUP BY name, base""")
def _(spark, sf):
    candidates = _candidates(spark, sf)
    return C.first_live_endpoint(candidates, _probes(candidates))


@query("c11_is_feed_payload", f"""
SELECT page_id, status < 400 AND {_FEED_MARK} AS is_feed FROM (SELECT page_id, CAST(200 + (page_id % 3) * 150 AS INTEGER) AS status,
  CASE WHEN page_id % 2 = 0 THEN '<?xml version="1.0"?>' || html ELSE html || '<rss>' END AS body FROM pages) x""")
def _(spark, sf):
    p = c("page_id")
    body = F.when(p % 2 == 0, F.concat(lit('<?xml version="1.0"?>'), "html")).otherwise(F.concat("html", lit("<rss>")))
    return table(spark, sf, "pages").select("page_id", C.is_feed_payload(200 + p % 3 * 150, body).alias("is_feed"))


@query("c12_alive_sources", f"""WITH {_PROBES}, {_SOURCES.strip()},
src AS (SELECT name, url AS rss_url FROM cand UNION ALL SELECT name, 'internal://' || position FROM seed)
SELECT name, rss_url FROM src WHERE starts_with(rss_url, 'internal://')
  OR rss_url IN (SELECT url FROM probes WHERE status < 400 AND {_FEED_MARK})""")
def _(spark, sf):
    candidates = _candidates(spark, sf)
    internal = _sources(spark, sf)[0].select("name", F.concat(lit("internal://"), c("position").cast("string")).alias("rss_url"))
    sources = candidates.select("name", c("url").alias("rss_url")).unionByName(internal)
    return C.alive_sources(sources, _probes(candidates))


@query("c13_toggle_sources", f"""WITH {_SOURCES},
tog AS (SELECT upper(replace('source.' || n_nationkey, '.', '_')) AS toggle_key, n_regionkey % 2 = 0 AS enabled FROM nation)
SELECT name, rss_url, coalesce(tog.enabled, disc.enabled) AS enabled, position
FROM disc LEFT JOIN tog ON tog.toggle_key = upper(replace(disc.name, '.', '_'))""")
def _(spark, sf):
    toggles = table(spark, sf, "nation").select(
        C.toggle_key(F.concat(lit("source."), c("n_nationkey").cast("string"))).alias("toggle_key"),
        (c("n_regionkey") % 2 == 0).alias("enabled"),
    )
    return C.toggle_sources(_sources(spark, sf)[1], toggles)
