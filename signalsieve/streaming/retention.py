"""Q12 and ST5 on tables that are partitioned by day.

Rows lie below their micro-batch and day. The retention is a moment that only moves forward, kept in a small table of
its own: moving it writes one row, rewrites no data, and a stream that goes on writing is not disturbed. Readers
take the days from that moment on, by partition metadata, and filter rows in its own day only. ``vacuum`` deletes
the folders of days that have wholly expired.

Rows without a time never expire.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, IntegerType, StructField, StructType

from signalsieve.functions.periods import utc_literal
from signalsieve.streaming.tables import exists, read_table


@dataclass(frozen=True)
class DayTable:
    """A table of rows with a time, appended by micro-batch and expired by day."""

    spark: SparkSession
    root: str
    schema: StructType
    time_col: str = "created_at"

    @property
    def _rows(self) -> DataFrame:
        places = [StructField("batch_id", IntegerType()), StructField("day", DateType())]
        return read_table(self.spark, f"{self.root}/rows", StructType([*self.schema.fields, *places]))

    def write(self, rows: DataFrame, batch: int) -> None:
        """The rows of a micro-batch; a replay overwrites them. A large day is several files."""
        rows = rows.select(*self.schema.names).withColumn("day", F.col(self.time_col).cast("date"))
        rows.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{self.root}/rows/batch_id={batch}")

    def kept_from(self) -> datetime | None:
        """The moment before which rows have expired; None while all are kept."""
        moved = read_table(self.spark, f"{self.root}/kept_from", "at timestamp")
        micros = moved.agg(F.max(F.unix_micros("at"))).first()[0]
        return None if micros is None else datetime(1970, 1, 1) + timedelta(microseconds=micros)

    def expire(self, retention_days: int, now: datetime, batch: int) -> None:
        """Moves the retention to ``retention_days`` before ``now``; 0 and less keep all. It never moves back."""
        if retention_days > 0:
            at = utc_literal(now.replace(microsecond=0) - timedelta(days=retention_days))
            self.spark.range(1).select(at.alias("at")).write.mode("overwrite").parquet(f"{self.root}/kept_from/batch_id={batch}")

    def _since(self, at: datetime) -> Column:
        # the day is a partition: whole days are taken or left by their folder
        later = (F.col("day") >= F.lit(at.date())) & (F.col(self.time_col) >= utc_literal(at))
        return F.col("day").isNull() | later

    def read(self) -> DataFrame:
        """All rows that have not expired."""
        at = self.kept_from()
        rows = self._rows if at is None else self._rows.where(self._since(at))
        return rows.drop("batch_id", "day")

    def expiring(self, retention_days: int, now: datetime) -> DataFrame:
        """Rows that ``expire`` with these arguments takes away: reads the days between both moments only."""
        if retention_days <= 0:
            return self._rows.where("false").drop("batch_id", "day")
        until = now.replace(microsecond=0) - timedelta(days=retention_days)
        gone = (F.col("day") <= F.lit(until.date())) & (F.col(self.time_col) < utc_literal(until))
        at = self.kept_from()
        rows = self._rows.where(gone)
        return (rows if at is None else rows.where(self._since(at))).drop("batch_id", "day")

    def vacuum(self) -> int:
        """Deletes the folders of wholly expired days; how many. For when no reader of an older state is left."""
        at = self.kept_from()
        if at is None or not exists(self.spark, f"{self.root}/rows"):
            return 0
        old = self._rows.where(F.col("day") < F.lit(at.date())).select("batch_id", "day").distinct().collect()
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        for place in old:  # one name a folder
            path = hadoop.Path(f"{self.root}/rows/batch_id={place.batch_id}/day={place.day}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return len(old)


def write_retained(
    stream: DataFrame, folder: str, retention_days: int, clock: Callable[[int], datetime], time_col: str = "created_at",
    trigger: dict | None = None,
) -> StreamingQuery:
    """ST5 on the stored table: each micro-batch appends its rows and moves the retention. ``clock(batch_id)`` is the
    time of a micro-batch. Read with ``DayTable.read``."""
    table = DayTable(stream.sparkSession, folder, stream.schema, time_col)

    def step(batch: DataFrame, batch_id: int) -> None:
        table.write(batch, batch_id)
        table.expire(retention_days, clock(batch_id), batch_id)

    return (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True})).start()
    )
