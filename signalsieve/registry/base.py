"""Registration of queries with their reference SQL, and the shared parts of that SQL.

The SQL is written on its own, in DuckDB's dialect; it shares only fixed word lists and
the definition of the derived views with the Spark side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, TimestampType

from signalsieve.functions import fixed_values as fv
from signalsieve.registry import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    """Text forms for types that two engines print differently."""
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, ArrayType):
            col = F.array_join(col.cast("array<string>"), "|")
        elif isinstance(f.dataType, TimestampType):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, DateType):
            col = col.cast("string")
        out.append(col.alias(f.name))
    return df.select(*out)


def query(name: str, oracle: str | None = None):
    """Registers ``fn(spark, sf_dir)`` under ``name``."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # calendar periods are cut in UTC plus an explicit offset
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return flat(fn(spark, sf_dir))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def any_in(text: str, words) -> str:
    return f"(len(list_filter({sql_list(words)}, lambda w: contains({text}, w))) > 0)"


def stamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def pick(key: str, values, last: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values)) + f" ELSE {q(last)} END"


ITEMS_ALL = f"""
it_all AS (
  SELECT doc_id AS id,
         '[' || CASE WHEN doc_id % 11 = 10 THEN 'GROUP' ELSE site END || '] ' || phrase AS title,
         'https://example.org/t/' || CAST(CASE WHEN doc_id % 10 = 9 THEN doc_id - 1 ELSE doc_id END AS VARCHAR) AS link,
         CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'yesterday'
              ELSE '2024-01-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') || 'T00:00:00Z' END AS pub_date,
         CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'author' || CAST(doc_id % 13 AS VARCHAR) END AS author,
         lang AS category, text AS content,
         CASE WHEN doc_id % 3 = 0 THEN text ELSE '' END AS full_content,
         ['https://example.org/files/' || CAST(doc_id AS VARCHAR) || '.zip'] AS download_links,
         site AS site_name,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(2 * (doc_id % 240) AS INTEGER)) AS created_at,
         CAST(doc_id % 8 AS INTEGER) AS source_rank, doc_id AS position
  FROM (SELECT *, {pick('doc_id % 8', views.SITES, views.LAST_SITE)} AS site,
               {pick('(doc_id * 7 + doc_id % 3) % 16', views.TITLES, views.LAST_TITLE)} AS phrase
        FROM documents) d
)"""
ITEMS = ITEMS_ALL + """,
it AS (
  SELECT * FROM it_all
  QUALIFY row_number() OVER (PARTITION BY link ORDER BY source_rank, position) = 1
)"""
STORED = ITEMS + f""",
stored AS (SELECT * FROM it WHERE created_at < TIMESTAMP '{views.STORED_BEFORE}')"""

_SKIPS = "[" + ", ".join(f"{{'k': {q(k)}, 'r': {q(r)}}}" for k, r in fv.SKIP_PATTERNS) + "]"


def triage_cte(source: str, name: str = "tri") -> str:
    return f"""
{name} AS (
  SELECT *, CASE WHEN named THEN 'analyze' WHEN skip IS NOT NULL THEN 'skip' ELSE 'analyze' END AS action,
         CASE WHEN named THEN 'named target detected' WHEN skip IS NOT NULL THEN skip
              ELSE 'passed default' END AS reason
  FROM (SELECT *, {any_in('lower(title)', fv.NAMED_TARGETS)} AS named,
               list_filter({_SKIPS}, lambda p: contains(lower(title), p.k))[1].r AS skip
        FROM {source}) x
)"""


_TYPES = "[" + ", ".join(
    f"{{'n': {q(n)}, 'w': {sql_list(w)}}}" for n, w in sorted(fv.DATA_TYPES.items())
) + "]"
_NOUNS = r"records?|rows?|accounts?|users?|emails?|lines?|entries|creds?|credentials?|passwords?|combos?"


def _numbers(units: str, scale: str) -> str:
    return (
        rf"list_transform(regexp_extract_all(text, '\b(\d[\d,\.]*)\s*({units})\b', 1), "
        f"lambda m: coalesce(try_cast(replace(m, ',', '') AS DOUBLE), 0) * {scale})"
    )


_BEST = (
    "list_max(list_concat(list_concat([0.0::DOUBLE], " + _numbers("billion|bln|b", "1e9") + "), list_concat("
    + _numbers("million|mln|m", "1e6") + ", list_concat(" + _numbers("k|thousand", "1e3") + ", "
    + _numbers(_NOUNS, "1.0") + "))))"
)


def has(types: str, *names: str) -> str:
    return "(" + " OR ".join(f"list_contains({types}, {q(n)})" for n in names) + ")"


def parts_cte(source: str, name: str = "parts") -> str:
    """Score components of the rows of ``source``."""
    return f"""
{name}_t AS (
  SELECT *, lower(title || ' ' || content) AS text, lower(site_name) AS site_l FROM {source}
),
{name}_v AS (
  SELECT *, list_filter({sql_list(fv.VENDOR_PATTERNS)}, lambda w: contains(text, w))[1] AS vendor FROM {name}_t
),
{name}_n AS (
  SELECT *, CASE WHEN vendor IS NOT NULL THEN 0 ELSE {_BEST} END AS best,
         CASE WHEN vendor IS NOT NULL THEN CAST([] AS VARCHAR[]) ELSE
           list_transform(list_filter({_TYPES}, lambda t: len(list_filter(t.w, lambda w: contains(text, w))) > 0),
                          lambda t: t.n) END AS found
  FROM {name}_v
),
{name}_b AS (
  SELECT *, CAST(CASE WHEN best <= 0 THEN -1 ELSE trunc(least(best, 2147483647)) END AS INTEGER) AS records,
         list_contains(found, 'combo') AS combo, list_filter(found, lambda t: t <> 'combo') AS types
  FROM {name}_n
),
{name}_s AS (
  SELECT *, CAST(CASE WHEN records >= 100000000 THEN 9 WHEN records >= 10000000 THEN 8 WHEN records >= 1000000 THEN 7
           WHEN records >= 100000 THEN 6 WHEN records >= 10000 THEN 5 WHEN records >= 1000 THEN 4
           WHEN records > 0 THEN 3 ELSE 2 END AS INTEGER) AS base,
         (vendor IS NULL AND NOT combo) AS ruled,
         {any_in('site_l', fv.TIER1_SITES)} AS tier1, {any_in('site_l', fv.TIER2_SITES)} AS tier2,
         {any_in('site_l', fv.RANSOM_SITES)} AS ransom,
         CAST(least(3, CASE WHEN list_contains(types, 'email') AND list_contains(types, 'password') THEN 2 ELSE 0 END
           + CASE WHEN {has('types', 'credit_card', 'financial')} THEN 2 ELSE 0 END
           + CASE WHEN {has('types', 'medical', 'government')} THEN 2 ELSE 0 END
           + CASE WHEN {has('types', 'ssn', 'dob')} THEN 1 ELSE 0 END
           + CASE WHEN list_contains(types, 'cookie') THEN 1 ELSE 0 END) AS INTEGER) AS types_boost
  FROM {name}_b
),
{name} AS (
  SELECT *, CAST(CASE WHEN neg THEN -2 WHEN pos THEN 1 ELSE 0 END AS INTEGER) AS freshness,
         CAST(CASE WHEN tier1 THEN 1 ELSE 0 END AS INTEGER) AS site_points,
         CAST(greatest(1, least(10, base + types_boost + CASE WHEN neg THEN -2 WHEN pos THEN 1 ELSE 0 END
              + CASE WHEN tier1 THEN 1 ELSE 0 END)) AS INTEGER) AS final,
         CASE WHEN NOT ruled THEN NULL
              WHEN {any_in('text', fv.COMBO_WORDS)} THEN 'credential_leak'
              WHEN {any_in('text', fv.DATABASE_WORDS)} THEN 'database_dump'
              WHEN {has('types', 'credit_card', 'financial')} THEN 'financial_data'
              WHEN list_contains(types, 'medical') THEN 'personal_info'
              WHEN list_contains(types, 'government') THEN 'database_dump'
              WHEN list_contains(types, 'source_code') THEN 'other'
              WHEN {any_in('text', fv.ACCESS_WORDS)} THEN 'access_sale'
              WHEN {has('types', 'email', 'password')} THEN 'credential_leak'
              WHEN len(types) > 0 THEN 'database_dump'
              WHEN {any_in('text', fv.RANSOM_SITES)} OR {any_in('site_l', fv.RANSOM_SITES)} THEN 'database_dump'
              WHEN {any_in('text', fv.DISCUSSION_WORDS)} THEN 'general_discussion'
              ELSE 'other' END AS rule_category
  FROM (SELECT *, ruled AND {any_in('text', fv.FRESH_POSITIVE)} AS pos,
               ruled AND {any_in('text', fv.FRESH_NEGATIVE)} AS neg FROM {name}_s) y
)"""


_SUMMARY = """
  site_name || ': ' || CASE rule_category WHEN 'credential_leak' THEN 'credential leak'
    WHEN 'database_dump' THEN 'database leak' WHEN 'financial_data' THEN 'financial data leak'
    WHEN 'personal_info' THEN 'personal information leak' WHEN 'access_sale' THEN 'access for sale'
    WHEN 'general_discussion' THEN 'general discussion' ELSE 'data leak' END
  || ', ' || CASE WHEN records >= 1000000 THEN 'about ' || CAST(records // 1000000 AS VARCHAR) || ' million records'
    WHEN records >= 1000 THEN 'about ' || CAST(records AS VARCHAR) || ' records' ELSE 'size unknown' END
  || ', data types: ' || CASE WHEN len(types) > 0 THEN array_to_string(types, ', ') ELSE 'unknown' END || '.'
  || CASE WHEN neg THEN ' Data may be old.' WHEN pos THEN ' Data looks recent.' ELSE '' END"""
_CONFIDENCE = """CASE WHEN records > 0 AND len(types) >= 2 THEN 'high'
    WHEN records > 0 OR len(types) >= 1 THEN 'medium' ELSE 'low' END"""
_URGENT = "(final >= 8 AND NOT neg AND (pos OR records >= 100000))"
_TAGS = """list_concat(types, list_filter([rule_category, CASE WHEN pos THEN 'fresh' END, CASE WHEN neg THEN 'stale' END,
    CASE WHEN tier1 THEN 'tier1-forum' END, CASE WHEN tier2 THEN 'tier2-forum' END,
    CASE WHEN ransom THEN 'ransomware-site' END], lambda t: t IS NOT NULL))"""
_REASONING = """'Rules: size ' || base || ', data types ' || types_boost || ', recency ' || freshness
    || ', site ' || site_points || ': ' || final || ' points. Records ' || records
    || ', types (' || array_to_string(types, ' ') || ')'"""


def scored_cte(parts: str = "parts", name: str = "scored") -> str:
    def choose(vendor: str, combo: str, rules: str) -> str:
        return f"CASE WHEN vendor IS NOT NULL THEN {vendor} WHEN combo THEN {combo} ELSE {rules} END"

    return f"""
{name} AS (
  SELECT *, CAST({choose('2', 'least(base, 4)', 'final')} AS INTEGER) AS score,
         {choose("'general_discussion'", "'credential_leak'", 'rule_category')} AS ai_category,
         {choose("['vendor-ad', 'low-value']", "list_concat(types, ['combo-aggregate'])", _TAGS)} AS tags,
         {choose("site_name || ': vendor advert or low-value post, no leak of its own.'",
                 "site_name || ': combined credential list, an aggregate and not a fresh leak.'", _SUMMARY)} AS summary,
         CAST([] AS VARCHAR[]) AS affected_targets, records AS estimated_records, types AS data_types,
         {choose('false', 'false', _URGENT)} AS is_urgent,
         {choose("'low'", "'low'", _CONFIDENCE)} AS confidence_level,
         {choose("'Rules: wording of sellers or spam, \"' || vendor || '\"'",
                 "'Rules: a collection of credentials, ' || least(base, 4) || ' points at most'", _REASONING)} AS reasoning
  FROM {parts}
)"""


ANALYSIS = (
    ITEMS + "," + triage_cte("it") + ",\nwanted AS (SELECT * FROM tri WHERE action = 'analyze'),"
    + parts_cte("wanted") + "," + scored_cte() + """,
an AS (
  SELECT id AS item_id, score, ai_category AS category, tags, summary, affected_targets, estimated_records, data_types,
         is_urgent, confidence_level, reasoning, 'rules-engine' AS model_used,
         created_at + to_seconds(5) AS analyzed_at
  FROM scored
)"""
)

RESULT_COLUMNS = """score, category, array_to_string(tags, '|') AS tags, summary,
  array_to_string(affected_targets, '|') AS affected_targets, estimated_records,
  array_to_string(data_types, '|') AS data_types, is_urgent, confidence_level, reasoning"""
