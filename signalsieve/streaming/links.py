"""ST2 and D1 over any span of time: an index of links in hash buckets, read bucket by bucket.

Each micro-batch writes its links as a run: Parquet in at most ``FOLDERS`` folders, each of a range of buckets, sorted by
bucket. Eight runs of a level become one of the next, so there are few runs however many batches came before, and every
link is rewritten once a level. A batch also writes the list of the runs as of itself; the next one reads that list and
lists no other folder. It finds the buckets of its own links first (at most ``buckets`` small numbers) and opens no file
of any other folder. A replay overwrites its own run and list and looks only at those before it.

``compact`` merges all links so far into one version with a folder a bucket; readers take the newest version that is
older than their batch.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from signalsieve.functions.periods import utc_literal
from signalsieve.operators.dedup import dedup_links
from signalsieve.streaming.tables import exists, read_table

INITIAL = -1
NONE = -2  # stands for no version
BUCKETS = 256
FOLDERS = 16  # of a run
FAN = 8  # runs of a level that become one of the next
RUNS = "place int, level int, last int, folder string"


@dataclass(frozen=True)
class LinkIndex:
    """Links seen so far, each with the smallest ``order`` (long columns) it came with and when it was seen last."""

    spark: SparkSession
    root: str
    order: tuple[str, ...] = ()
    buckets: int = BUCKETS

    @property
    def _fields(self) -> str:
        return ", ".join(["link string", *(f"{c} long" for c in self.order), "seen timestamp", "bucket int"])

    def _bucket(self, link: Column) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(link, F.lit(""))), F.lit(self.buckets)).cast("int")

    def _folder_of(self, bucket):
        """The first bucket of the range that ``bucket`` lies in."""
        return bucket - bucket % -(-self.buckets // FOLDERS)

    def create(self, links: DataFrame, seen: datetime = datetime(1970, 1, 1)) -> "LinkIndex":
        """An index of the links of a table that has none yet."""
        if not self._runs(INITIAL + 1) and not exists(self.spark, f"{self.root}/batches/batch_id={INITIAL}"):
            self.add(links, INITIAL, seen)
        return self

    def _columns(self, seen: Column) -> list[Column | str]:
        return ["link", *(F.col(c).cast("long").alias(c) for c in self.order), seen.alias("seen")]

    def _write_run(self, rows: DataFrame, run: Row) -> None:
        bucket = self._bucket(F.col("link"))
        (
            rows.withColumns({"slot": bucket, "bucket": self._folder_of(bucket)})
            .repartition("slot").sortWithinPartitions("bucket", "slot")  # small runs are one task and a file a folder
            .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{run.folder}")
        )

    def _read_runs(self, runs: Sequence[Row]) -> DataFrame:
        fields = f"{self._fields}, batch_id int, slot int"
        if not runs:
            return self.spark.createDataFrame([], fields)
        read = self.spark.read.schema(f"{fields}, run string").option("basePath", f"{self.root}/runs")
        return read.parquet(*(f"{self.root}/{r.folder}" for r in runs)).drop("run")

    def _runs(self, before: int) -> list[Row]:
        """The runs that hold all batches before the given one, oldest first."""
        found = read_table(self.spark, f"{self.root}/index/batch_id={before - 1}", RUNS).collect()
        if not found and before > INITIAL + 1:  # the numbers of batches may have a gap
            every = read_table(self.spark, f"{self.root}/index", f"{RUNS}, batch_id int").where(F.col("batch_id") < before)
            newest = every.agg(F.max("batch_id")).first()[0]
            found = [] if newest is None else every.where(F.col("batch_id") == newest).drop("batch_id").collect()
        return sorted(found, key=lambda r: r.place)

    def add(self, rows: DataFrame, batch: int, seen: datetime) -> None:
        """Adds the links of a micro-batch. Distinct links, or the smallest order counts."""
        new = _run(batch, 0)
        self._write_run(rows.select(*self._columns(utc_literal(seen)), F.lit(batch).alias("batch_id")), new)
        version = self._version(batch)
        runs = [r for r in self._runs(batch) if r.last > version] + [new]
        level, start = 0, len(runs)
        # a full level moves up, and with it the next one where that fills it
        while (n := sum(r.level == level for r in runs[:start]) + (level > 0)) >= FAN:
            start, level = start - n + (level > 0), level + 1
        if start < len(runs):
            merged = _run(batch, level)
            self._write_run(self._read_runs(runs[start:]).drop("slot", "bucket"), merged)
            runs[start:] = [merged]
        listed = [(i, r.level, r.last, r.folder) for i, r in enumerate(runs)]
        self.spark.createDataFrame(listed, RUNS).coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/index/batch_id={batch}")

    def _version(self, before: int) -> int:
        if not exists(self.spark, f"{self.root}/upto"):
            return NONE
        done = read_table(self.spark, f"{self.root}/upto", "batch_id int")
        found = done.where(F.col("batch_id") < before).agg(F.max("batch_id")).first()[0]
        return NONE if found is None else found

    def _read(self, before: int, buckets: Sequence[int] | None = None) -> DataFrame:
        """All rows before a batch, or those of the given buckets."""
        version, batch = self._version(before), F.col("batch_id")

        def chosen(rows: DataFrame, column: str, of: Sequence[int] | None) -> DataFrame:
            return rows if of is None or len(of) == self.buckets else rows.where(F.col(column).isin([*of]))

        runs = self._read_runs([r for r in self._runs(before) if r.last > version]).where((batch > version) & (batch < before))
        folders = None if buckets is None else sorted({self._folder_of(b) for b in buckets})
        out = [chosen(chosen(runs, "bucket", folders), "slot", buckets).drop("batch_id", "slot")]
        if version != NONE:
            out.append(chosen(read_table(self.spark, f"{self.root}/versions/batch_id={version}", self._fields), "bucket", buckets))
        if exists(self.spark, f"{self.root}/batches"):  # an index of an earlier version: a folder a batch and bucket
            old = read_table(self.spark, f"{self.root}/batches", f"{self._fields}, batch_id int")
            out.append(chosen(old.where((batch > version) & (batch < before)), "bucket", buckets).drop("batch_id"))
        return reduce(DataFrame.unionByName, out)

    def touched(self, links: DataFrame) -> list[int]:
        """Buckets of the given links: at most ``buckets`` numbers."""
        return [r[0] for r in links.select(self._bucket(F.col("link"))).distinct().collect()]

    def known(self, links: DataFrame, before: int) -> DataFrame:
        """link and its smallest order among all batches before, for those of ``links`` that were seen."""
        rows = self._read(before, self.touched(links))
        met = rows.join(links.select("link").distinct(), "link", "left_semi")
        if not self.order:
            return met.select("link").distinct()
        best = F.min(F.struct(*self.order)).alias("_best")
        return met.groupBy("link").agg(best).select("link", "_best.*")

    def compact(self, upto: int, seen_since: datetime | None = None) -> None:
        """Merges all batches up to ``upto`` into one version, without links last seen before ``seen_since``.

        Batches after ``upto`` may be written meanwhile; readers see the version once it is complete."""
        rows = self._read(upto + 1)
        best = [F.min(F.struct(*self.order)).alias("_best")] if self.order else []
        merged = rows.groupBy("link").agg(*best, F.max("seen").alias("seen"))
        if seen_since is not None:
            merged = merged.where(F.col("seen") >= utc_literal(seen_since))
        merged = merged.select("link", *(F.col(f"_best.{c}").alias(c) for c in self.order), "seen")
        # one file for each bucket
        merged.withColumn("bucket", self._bucket(F.col("link"))).repartition("bucket").write.mode("overwrite").partitionBy(
            "bucket").parquet(f"{self.root}/versions/batch_id={upto}")
        # one row that says the version is complete
        self.spark.range(1).drop("id").withColumn("_", F.lit(1)).coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/upto/batch_id={upto}")


def _run(batch: int, level: int) -> Row:
    return Row(place=0, level=level, last=batch, folder=f"runs/run=batch{batch}level{level}")


def first_rows_of_batch(batch: DataFrame, batch_id: int, folder: str, index: LinkIndex, seen: datetime) -> None:
    """One micro-batch of ``write_first_rows``: stores rows whose link is new, or came with a smaller order."""
    spark, order = batch.sparkSession, list(index.order)
    known = index.known(batch, before=batch_id).withColumnsRenamed({c: f"_old_{c}" for c in order}).withColumn("_hit", F.lit(True))
    best = dedup_links(batch, [F.col(c) for c in order]).join(known, "link", "left")
    better = F.struct(*(F.col(c).cast("long").alias(c) for c in order)) < F.struct(*(F.col(f"_old_{c}").alias(c) for c in order))
    best.where(F.col("_hit").isNull() | better).select(*batch.columns).write.mode("overwrite").parquet(
        f"{folder}/rows/batch_id={batch_id}")
    index.add(spark.read.schema(batch.schema).parquet(f"{folder}/rows/batch_id={batch_id}"), batch_id, seen)


def write_first_rows(
    stream: DataFrame, folder: str, clock, order: Sequence[str] = ("source_rank", "position"),
    buckets: int = BUCKETS, trigger: dict | None = None,
) -> StreamingQuery:
    """ST2 without a horizon: of every link the row with the smallest ``order`` over all batches, late duplicates
    included. ``clock(batch_id)`` is the time of a micro-batch. Read with ``read_first_rows``."""
    index = LinkIndex(stream.sparkSession, f"{folder}/links", tuple(order), buckets)
    return (
        stream.writeStream.foreachBatch(lambda df, n: first_rows_of_batch(df, n, folder, index, clock(n)))
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
    )


def read_first_rows(spark: SparkSession, folder: str, schema, order: Sequence[str] = ("source_rank", "position")) -> DataFrame:
    """The rows that ``write_first_rows`` has kept: one a link. Rows that a later, smaller one replaced are passed over."""
    rows = read_table(spark, f"{folder}/rows", schema)
    first = Window.partitionBy("link").orderBy(*(F.col(c) for c in order))
    return rows.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")
