"""The tables behind the stream: append-only Parquet, one folder per micro-batch.

A replayed micro-batch overwrites its own folder and reads only the folders before it, so
every write is idempotent and no job reads a path it is writing.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

from signalsieve import schemas
from signalsieve.operators.alerts import pending_urgent_outbox
from signalsieve.operators.store import newest_analysis, prune
from signalsieve.streaming.links import LinkIndex
from signalsieve.streaming.tables import exists, read_table

OUTBOX = StructType(
    [f for f in schemas.ANALYSIS.fields if f.name in ("item_id",)]
    + [StructField(n, StringType()) for n in ("title", "body", "link", "site_name", "kind")]
    + [f for f in schemas.RESULT.fields if f.name in
       ("score", "category", "summary", "affected_targets", "data_types", "estimated_records",
        "is_urgent", "confidence_level")]
    + [StructField(n, StringType()) for n in ("channel", "layout", "payload")]
)
# urgent alerts that no batch has sent yet, as of each batch
OPEN_URGENT = StructType([f for f in OUTBOX.fields if f.name not in ("channel", "layout", "payload")])
COUNTERS = StructType(
    [StructField("site_name", StringType())] + [StructField(n, LongType()) for n in ("fetched", "new", "stale", "fresh")]
    + [StructField("counted_at", TimestampType())]
)
NOTICES = StructType([StructField(n, StringType()) for n in ("kind", "period", "title", "body", "channel", "layout", "payload")])
ANSWERS = StructType(
    [StructField("item_id", LongType()), StructField("provider", StringType()), StructField("ord", IntegerType()),
     StructField("json", StringType()), StructField("error", StringType())]
)
CYCLES = StructType([StructField("done_at", TimestampType())])
TABLES = {
    "items": schemas.ITEMS, "analysis": schemas.ANALYSIS, "outbox": OUTBOX, "notified": schemas.NOTIFIED,
    "open_urgent": OPEN_URGENT, "counters": COUNTERS, "notices": NOTICES, "answers": ANSWERS, "cycles": CYCLES,
}
INITIAL = -1


@dataclass(frozen=True)
class Store:
    """The tables of the cycle and the index of stored links under one shared folder."""

    spark: SparkSession
    root: str

    @property
    def links(self) -> LinkIndex:
        return LinkIndex(self.spark, f"{self.root}/_links")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def create(self) -> "Store":
        """Marks a new store. One of an earlier version gets what it lacks: an index of its links, and as open ones the
        urgent items that nobody was told about."""
        if exists(self.spark, self.path("cycles")):
            return self
        if exists(self.spark, self.path("items")):
            missed = pending_urgent_outbox(self.read("items"), self.current_analysis(), self.read("notified"))
            self.write("open_urgent", missed, INITIAL)
            self.links.create(self.read("items"))
        self.write("cycles", self.spark.createDataFrame([], CYCLES), INITIAL)
        return self

    def last_batch(self, before: int) -> int:
        """The last complete batch before the given one."""
        if not self.read("cycles", batch=before - 1).isEmpty():
            return before - 1
        # the numbers of batches may have a gap
        rows = read_table(self.spark, self.path("cycles"), "done_at timestamp, batch_id int")
        found = rows.filter(F.col("batch_id") < before).agg(F.max("batch_id")).first()[0]
        return INITIAL if found is None else found

    def read(self, table: str, before: int | None = None, batch: int | None = None) -> DataFrame:
        if batch is not None:  # no other folder is listed, however many there are
            return read_table(self.spark, f"{self.path(table)}/batch_id={batch}", TABLES[table])
        schema = StructType(TABLES[table].fields + [StructField("batch_id", IntegerType())])
        rows = read_table(self.spark, self.path(table), schema)
        if before is not None:
            rows = rows.filter(F.col("batch_id") < before)
        return rows.drop("batch_id")

    def write(self, table: str, rows: DataFrame, batch: int) -> None:
        schemas.conform(rows, TABLES[table], {}).write.mode("overwrite").parquet(
            f"{self.path(table)}/batch_id={batch}"
        )

    def current_analysis(self) -> DataFrame:
        """Analysis with one row per item, the latest."""
        return newest_analysis(self.read("analysis"))

    def pruned_copy(self, root: str, retention_days: int, now: datetime) -> "Store":
        """A new version of the store without expired items (Q12). The old one stays as it
        is until readers have moved on."""
        kept = prune(self.read("items"), self.current_analysis(), retention_days, now)
        target = Store(self.spark, root)
        target.write("items", kept.items, INITIAL)
        target.write("analysis", kept.analysis, INITIAL)
        alive = target.read("items").select(F.col("id").alias("item_id"))
        target.write("notified", self.read("notified").join(alive, "item_id", "left_semi"), INITIAL)
        for table in ("outbox", "counters", "notices"):
            target.write(table, self.read(table), INITIAL)
        return target.create()
