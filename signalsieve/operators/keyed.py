"""Q9 and D3 on a stored table that is merged part by part.

Rows lie in Parquet by ``part``, a hash of their key, and inside each part in files bucketed and sorted by the
key. A merge reads and writes the parts its own keys fall in (at most ``parts`` small numbers); files of other
parts are not opened and keep their names. Inside these parts the stored side joins where it lies: the
buckets are its partitioning, so that only the batch is shuffled.

A merge writes whole parts beside the table and moves them in when all are written (dynamic partition
overwrite). One that is cut short may be run again: the same batch gives the same rows. One writer at a time;
readers during the moves may have to read again.

Defined results: a null key matches nothing, so such rows are always added; repeated keys of a batch must have been
resolved before (``newest_analysis``, ``dedup_links``); an empty batch changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from signalsieve.operators.dedup import dedup_links
from signalsieve.operators.store import newest_analysis
from signalsieve.streaming.tables import exists

PARTS = 64
BUCKETS = 256
MODE = "spark.sql.sources.partitionOverwriteMode"


@dataclass(frozen=True)
class KeyedTable:
    """A table at ``path`` known as ``name`` to the catalogue of the session; declare it in every session."""

    spark: SparkSession
    name: str
    path: str
    schema: StructType
    key: str
    parts: int = PARTS
    buckets: int = BUCKETS

    def declare(self) -> "KeyedTable":
        """Makes the table known; rows that lie at its path already are found again."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, part INT) USING parquet PARTITIONED BY (part) "
            f"CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        if exists(self.spark, self.path):
            self.spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")
        return self

    def part_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(self.parts)).cast("int")

    def _with_part(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.schema.names, self.part_of(F.col(self.key)).alias("part"))

    def read(self) -> DataFrame:
        return self.spark.table(self.name).drop("part")

    def touched(self, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in keys.select(self.part_of(F.col(self.key))).distinct().collect())

    def _stored(self, keys: DataFrame) -> DataFrame:
        return self.spark.table(self.name).where(F.col("part").isin(self.touched(keys)))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Q11: stored rows of the given keys; reads the parts of these keys only."""
        wanted = keys.select(self.key).distinct()
        return self._stored(wanted).join(wanted, self.key, "left_semi").select(*self.schema.names)

    def merged(self, rows: DataFrame, new_wins: bool) -> DataFrame:
        """The touched parts after the merge, ``part`` last."""
        old, new = F.col("_old"), F.col("_new")
        here = self._stored(rows).select(F.col(self.key).alias("_key"), F.struct(*self.schema.names, "part").alias("_old"))
        there = self._with_part(rows).select(F.col(self.key).alias("_new_key"), F.struct("*").alias("_new"))
        joined = here.join(there, F.col("_key") == F.col("_new_key"), "full_outer")
        kept = F.coalesce(new, old) if new_wins else F.coalesce(old, new)
        return joined.select(kept.alias("_row")).select("_row.*")

    def _write(self, rows: DataFrame) -> None:
        before = self.spark.conf.get(MODE, None)
        self.spark.conf.set(MODE, "dynamic")
        try:
            rows.write.insertInto(self.name, overwrite=True)
        finally:
            if before is None:
                self.spark.conf.unset(MODE)
            else:
                self.spark.conf.set(MODE, before)

    def replace(self, rows: DataFrame) -> "KeyedTable":
        """First fill: the parts of ``rows`` hold these rows and no others."""
        self._write(self._with_part(rows).repartition(self.buckets, self.key))
        return self

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace stored ones of the same key."""
        self._write(self.merged(rows, new_wins=True))

    def insert_ignore(self, rows: DataFrame) -> None:
        """Rows whose key is stored already are left out."""
        self._write(self.merged(rows, new_wins=False))


def merge_analysis(table: KeyedTable, new: DataFrame) -> None:
    """Q9 on a stored table: the newest row per item of the batch replaces what is stored."""
    table.upsert(newest_analysis(new))


def merge_items(table: KeyedTable, batch: DataFrame, order: list[Column] | None = None) -> None:
    """D3 on a stored table keyed by link: the first row of each unseen link is added."""
    table.insert_ignore(dedup_links(batch, order))
