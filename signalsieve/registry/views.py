"""Item, analysis, catalogue and event views that Spark derives from the given tables.

The given tables hold no forum posts. Every view below keeps all rows and whole texts.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalsieve.operators.dedup import dedup_links
from signalsieve.operators.scoring import as_analysis, score_items
from signalsieve.operators.triage import ANALYZE, triage
from signalsieve.sources.tables import spread

NOW = datetime(2024, 1, 20, 12, 0, 0)
STORED_BEFORE = datetime(2024, 1, 12, 0, 0, 0)

SITES = ["leakbase", "xss-is", "probiv", "ransomwatch", "cardforum", "press", "haveibeenpwned"]
LAST_SITE = "board"
TITLES = [
    "fresh database of 5 million users email password",
    "combolist 120k lines mail:pass",
    "sell cvv telegram @shop",
    "hospital patient data 25,000 records 2025",
    "netflix account bundle",
    "source code of a bank portal",
    "old dump from 2019 with 1.2 billion rows",
    "rdp shell to a city office",
    "how to guide",
    "credit card table 900 rows",
    "ssn and date of birth 9,999 records",
    "session cookie set 150k entries latest",
    "weekly notes",
    "iban and wire transfer table 1,000,000 records today",
    "wordlist pack",
]
LAST_TITLE = "sample 0.5 rows"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key, values, last):
    out = None
    for i, value in enumerate(values):
        out = F.when(key == i, value) if out is None else out.when(key == i, value)
    return out.otherwise(last)


def items_all(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """One item per document, about a tenth of the links repeated. ``heavy`` spreads a
    single-split input over the cores before text-heavy work."""
    docs = table(spark, sf_dir, "documents")
    return items_from(spread(docs) if heavy else docs)


def items_from(docs: DataFrame) -> DataFrame:
    """The item view of a batch or stream of documents."""
    d = F.col("doc_id")
    phrase = _pick((d * 7 + d % 3) % 16, TITLES, LAST_TITLE)
    docs = docs.withColumn("site", _pick(d % 8, SITES, LAST_SITE))
    prefix = F.when(d % 11 == 10, F.lit("GROUP")).otherwise(F.col("site"))
    day = F.lpad((d % 28 + 1).cast("string"), 2, "0")
    return docs.select(
        d.alias("id"),
        F.concat(F.lit("["), prefix, F.lit("] "), phrase).alias("title"),
        F.concat(
            F.lit("https://example.org/t/"), F.when(d % 10 == 9, d - 1).otherwise(d).cast("string")
        ).alias("link"),
        F.when(d % 5 == 0, "").when(d % 5 == 1, "yesterday")
        .otherwise(F.concat(F.lit("2024-01-"), day, F.lit("T00:00:00Z"))).alias("pub_date"),
        F.when(d % 4 == 0, "").otherwise(F.concat(F.lit("author"), (d % 13).cast("string"))).alias("author"),
        F.col("lang").alias("category"),
        F.col("text").alias("content"),
        F.when(d % 3 == 0, F.col("text")).otherwise("").alias("full_content"),
        F.array(F.concat(F.lit("https://example.org/files/"), d.cast("string"), F.lit(".zip"))).alias("download_links"),
        F.col("site").alias("site_name"),
        (F.timestamp_seconds(F.lit(1704067200) + (d % 240) * 7200)).alias("created_at"),
        (d % 8).cast("int").alias("source_rank"),
        d.alias("position"),
    )


def items_unique(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    return dedup_links(items_all(spark, sf_dir, heavy)).drop("source_rank", "position")


def items_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that count as stored already: those created before a given moment."""
    from signalsieve.functions.periods import utc_literal

    return items_unique(spark, sf_dir).filter(F.col("created_at") < utc_literal(STORED_BEFORE))


def analysis_of(items: DataFrame) -> DataFrame:
    """Rule analysis of the items that pass triage, five seconds after creation."""
    wanted = triage(items).filter(F.col("action") == ANALYZE)
    scored = score_items(wanted, keep=("id", "created_at"))
    return as_analysis(scored, F.col("created_at") + F.expr("INTERVAL 5 SECONDS"))


def analysis_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis_of(items_unique(spark, sf_dir, heavy=True))


def event_items(events: DataFrame) -> DataFrame:
    """Events as items: one link per user and event type."""
    user = F.col("user_id").cast("string")
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("props")).alias("title"),
        F.concat(F.lit("https://example.org/e/"), user, F.lit("/"), F.col("event_type")).alias("link"),
        F.date_format(F.col("ts") - F.make_dt_interval(F.col("event_id").cast("int") % 14),
                      "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("pub_date"),
        F.concat(F.lit("site"), (F.col("user_id") % 20).cast("string")).alias("site_name"),
        F.date_trunc("second", "ts").alias("created_at"),
    )
