"""ST2 to ST5: dedup, late data, calendar windows and retention on streams.

All functions also take batch DataFrames, which gives every stream a batch twin.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType

from signalsieve.functions import fixed_values as fv
from signalsieve.functions.periods import utc_literal
from signalsieve.operators.dedup import published_at
from signalsieve.streaming.tables import read_table

COUNTS = "window_start timestamp, window_end timestamp, site_name string, n long"


def stream_dedup(stream: DataFrame, retention: str = "90 days", time_col: str = "created_at") -> DataFrame:
    """ST2: one row per link. State is kept for the retention only; exact dedup beyond it is
    D1 against the stored table in ``foreachBatch``."""
    return stream.withWatermark(time_col, retention).dropDuplicatesWithinWatermark(["link"])


def is_late(pub_date: Column, reference: Column, max_age_days: int) -> Column:
    """Older than the age limit at ingest; no usable date is never late."""
    if max_age_days <= 0:
        return F.lit(False)
    limit = reference - F.make_dt_interval(F.lit(max_age_days))
    return F.coalesce(published_at(pub_date) <= limit, F.lit(False))


def stream_late(stream: DataFrame, max_age_days: int, now: datetime | None = None) -> DataFrame:
    """ST3: adds ``late``. Late rows are stored but not scored: ``write_split`` keeps both sides."""
    reference = utc_literal(now) if now is not None else F.col("created_at")
    return stream.withColumn("late", is_late(F.col("pub_date"), reference, max_age_days))


def write_split(
    stream: DataFrame, folder: str, max_age_days: int, now: datetime | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """ST3 as one query with two outputs below ``folder``: timely rows and late rows, and a metric of each batch.

    A micro-batch is computed once and commits both sides together; a replay overwrites them. The metric is
    counted from the written rows.
    """
    schema = StructType([*stream.schema.fields, StructField("late", BooleanType())])

    def put(batch: DataFrame, batch_id: int) -> None:
        path = f"{folder}/rows/batch_id={batch_id}"
        stream_late(batch, max_age_days, now).write.mode("overwrite").partitionBy("late").parquet(path)
        rows = batch.sparkSession.read.schema(schema).parquet(path)
        metric = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("late").alias("n_late"), F.max("created_at").alias("newest"))
        metric.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(
            f"{folder}/metrics/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(
        **(trigger or {"availableNow": True})).start()


def read_side(spark: SparkSession, folder: str, schema: StructType, late: bool) -> DataFrame:
    """Late or timely rows of ``write_split`` so far; the files of the other side are not read."""
    whole = StructType([*schema.fields, StructField("late", BooleanType())])
    rows = read_table(spark, f"{folder}/rows", whole)
    return rows.where(F.col("late") == F.lit(late)).select(*schema.names)


def read_split_metrics(spark: SparkSession, folder: str, max_age_days: int) -> DataFrame:
    """batch, n, n_late, newest, watermark of each micro-batch; the watermark is the newest row so far less the age
    limit, and never moves back. One row per batch passes the window."""
    rows = read_table(spark, f"{folder}/metrics", "n long, n_late long, newest timestamp, batch long")
    so_far = F.max("newest").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("batch", "n", "n_late", "newest", (so_far - F.make_dt_interval(F.lit(max_age_days))).alias("watermark"))


def _starts(tz_offset_hours: int) -> dict[str, str]:
    hours = -tz_offset_hours % 24
    # the epoch is a Thursday: the first Monday is four days in, three when the local
    # day starts on the UTC day before
    days = 3 if tz_offset_hours > 0 else 4
    return {"1 day": f"{hours} hours", "7 days": f"{days} days {hours} hours"}


def stream_counts(
    stream: DataFrame,
    kind: str = "daily",
    delay: str = "0 seconds",
    tz_offset_hours: int = fv.DEFAULT_TZ_OFFSET_HOURS,
    time_col: str = "created_at",
) -> DataFrame:
    """ST4: items per source and local day or Monday week, in one stateful query.

    As a stream in append mode it emits closed windows only, and rows later than ``delay`` behind the
    newest are dropped. ``write_counts`` and ``read_counts`` lose none and show open windows.
    """
    size = "1 day" if kind == "daily" else "7 days"
    bins = F.window(time_col, size, startTime=_starts(tz_offset_hours)[size])
    return (
        stream.withWatermark(time_col, delay)
        .groupBy(bins.alias("w"), "site_name")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "site_name", "n")
    )


def write_counts(
    stream: DataFrame, folder: str, kind: str = "daily", tz_offset_hours: int = fv.DEFAULT_TZ_OFFSET_HOURS,
    time_col: str = "created_at", trigger: dict | None = None,
) -> StreamingQuery:
    """ST4 without loss: each micro-batch adds its own counts below ``folder``, a replay overwrites them.

    No row is too late and no state is kept; late rows add to the window they belong to.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        counts = stream_counts(batch, kind, tz_offset_hours=tz_offset_hours, time_col=time_col)
        counts.write.mode("overwrite").parquet(f"{folder}/counts/batch={batch_id}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/checkpoint").trigger(
        **(trigger or {"availableNow": True})).start()


def read_counts(spark: SparkSession, folder: str) -> DataFrame:
    """window_start, window_end, site_name, n of all windows so far, open ones included; none before the first batch."""
    parts = read_table(spark, f"{folder}/counts", COUNTS)
    return parts.groupBy("window_start", "window_end", "site_name").agg(F.sum("n").alias("n"))


def stream_retention(stream: DataFrame, retention_days: int, now: datetime, time_col: str = "created_at") -> DataFrame:
    """ST5: only rows inside the retention; state of other operators expires by watermark
    and stored tables by Q12."""
    if retention_days <= 0:
        return stream
    kept = stream.withWatermark(time_col, f"{retention_days} days")
    return kept.filter(F.col(time_col) >= utc_literal(now - timedelta(days=retention_days)))
