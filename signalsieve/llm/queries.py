"""The registered queries of this package, each over its whole table, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalsieve.llm import (
    compression_quality, decontamination, html_text, license_scan, mixing, ngram_join, prefix_trie, quality_rules,
    token_counts, token_files, toxicity_chain, warc, whitening,
)
from signalsieve.llm.shared import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers ``fn(spark, sf_dir)`` under ``name``."""

    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# words are runs of anything but ASCII white space
WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MEASURES_SQL = rf"""
w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS_SQL} AS words FROM documents),
t AS (
  SELECT *, list_transform(range(1, len(words) - 1),
                           lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS tri,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM w
),
grams AS (
  SELECT doc_id, gram, list(pos) AS places
  FROM (SELECT doc_id, unnest(tri) AS gram, unnest(range(1, len(tri) + 1)) AS pos FROM t)
  GROUP BY doc_id, gram HAVING count(*) > 1
),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_repeat_words
  FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS place FROM (SELECT doc_id, unnest(places) AS p FROM grams))
  GROUP BY doc_id
),
measures AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN covered USING (doc_id)
),
judged AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
         (10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
          OR 20 * n_dup_lines > n_words) AS rejected
  FROM measures
)"""


@query("op10_quality_rules", f"""WITH {MEASURES_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT rejected) AS kept
FROM judged""")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@query("op1_mixing")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "weight", "target", "taken")


@query("op9_token_files")
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    token_files.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_back(spark, path)


@query("op7_decontamination")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_ngram_join")
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"))


@query("op2_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT payload_digest AS wd, max(page_id) AS first_id FROM p WHERE octet_length(payload) >= 1000 GROUP BY 1)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN w ON payload_digest = wd AND octet_length(payload) >= 1000""")
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, out = new_folder(spark, "arc"), new_folder(spark, "warc")
    warc.write_arc(table(spark, sf_dir, "pages"), arc)
    warc.to_warc(spark, arc, out)
    return warc.read_warc(spark, out).where("record_type <> 'warcinfo'").select(
        F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to_row").alias("refers_to"))


@query("op6_compression_quality")
def op6_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return compression_quality.score(docs, compression_quality.fit(docs, table(spark, sf_dir, "labels")))


@query("op5_html_text")
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


@query("op4_toxicity_chain")
def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_chain.score(docs, toxicity_chain.fit(docs, table(spark, sf_dir, "labels")))


@query("op8_license_scan")
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


# CRC-32 of a decimal number: each byte, then eight shifts
CRC_SQL = """xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1),
                lambda i: ascii(substr(CAST(conv_id AS VARCHAR), i, 1))::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [k::BIGINT for k in range(8)]),
                             lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)))"""


@query("op11_prefix_trie", f"""
WITH o AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL)
),
h AS (SELECT conv_id, {CRC_SQL} % 6 AS h FROM (SELECT DISTINCT conv_id FROM o)),
r AS (
  SELECT h.conv_id, 0 AS own, o.pos, role, text FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 100 AND o.pos <= h.h
  UNION ALL
  SELECT conv_id, 1 AS own, pos, role, text FROM h JOIN o USING (conv_id) WHERE pos > h.h
),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, text,
             sha256(length(role) || ':' || role || text) AS turn FROM r),
p AS (
  SELECT a.conv_id, a.depth, any_value(length(a.text)) AS chars,
         sha256(string_agg(b.turn, '' ORDER BY b.depth)) AS path
  FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.depth <= a.depth GROUP BY a.conv_id, a.depth
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM h
),
q AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM q GROUP BY path, depth
),
u AS (SELECT n.path, q.path AS up FROM n JOIN q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1),
c AS (SELECT up AS path, count(*) AS n_children FROM u GROUP BY up),
t AS (
  SELECT q.path, sum(CASE WHEN c.path IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens
  FROM n LEFT JOIN c ON c.path = n.path JOIN q ON q.conv_id = n.conv_id AND q.depth <= n.depth GROUP BY q.path
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, a.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs,
       CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN t USING (path) LEFT JOIN c ON c.path = n.path LEFT JOIN u ON u.path = n.path LEFT JOIN n a ON a.path = u.up""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


TOKEN_LIMIT = 512


@query("op13_token_counts")
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call fills a cache of its own; a lasting one is a path that runs share."""
    counts = token_counts.count_tokens(
        table(spark, sf_dir, "documents"), new_folder(spark, "token-counts"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)
