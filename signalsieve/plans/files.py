"""One file per period, written by many tasks at once.

A text file is one sequence of bytes, yet a large period must not pass one task. The blocks are
range-partitioned in file order and checkpointed; the bytes that every partition adds to every file
then give each partition its place in it. The tasks write their bytes at those places of a staged
file, and the commit on the driver checks the sizes and renames the staged files, which moves no data.

Recovery: a task that runs twice, or twice at a time, writes the same bytes to the same places. Before
the commit nothing is seen under the final names; a job that fails leaves earlier files as they were.

The folder must be a mounted, shared one (as ``spark.checkpoint.dir`` is), for object stores and HDFS
know no writing at a place; there ``write_blocks`` gives several fragments a period.

Defined results: rows of a null period go to the file ``undated``; no rows, no files; files of other
periods in the folder stay.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from signalsieve.session import ensure_checkpoint_dir

FORMAT = "signalsieve_placed_files"
UNDATED = "undated"


def local_path(folder: str) -> str:
    """The path of a mounted folder; an error for any other file system."""
    path = folder.removeprefix("file://") if folder.startswith("file://") else folder.removeprefix("file:")
    if "://" in path or not path.startswith("/"):
        raise ValueError(f"not the path of a mounted folder: {folder}")
    return path


@dataclass
class Written(WriterCommitMessage):
    """Bytes that a task has written to each file."""

    sizes: dict[str, int]


class PlacedFiles(DataSource):
    """Sink for rows (file, start, value): the values of a partition, in its order, from ``start`` on."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> "PlacedFilesWriter":
        return PlacedFilesWriter(self.options["path"], self.options["staging"])


class PlacedFilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, staging: str):
        self.folder, self.staging = folder, staging

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        sizes: dict[str, int] = {}
        for batch in iterator:
            for file in pc.unique(batch.column("file")).to_pylist():
                rows = batch.filter(pc.equal(batch.column("file"), file))
                at = rows.column("start")[0].as_py() + sizes.get(file, 0)
                sizes[file] = sizes.get(file, 0) + self._put(file, at, rows.column("value"))
        return Written(sizes)

    def _put(self, file: str, at: int, values: pa.Array) -> int:
        os.makedirs(self.staging, exist_ok=True)
        handle = os.open(os.path.join(self.staging, file), os.O_CREAT | os.O_WRONLY, 0o644)
        began = at
        try:
            for value in values:
                left = memoryview(value.as_buffer())
                while len(left):
                    done = os.pwrite(handle, left, at)
                    at, left = at + done, left[done:]
            os.fsync(handle)
        finally:
            os.close(handle)
        return at - began

    def commit(self, messages: list[Written | None]) -> None:
        due: dict[str, int] = {}
        for message in messages:
            for file, size in (message.sizes if message else {}).items():
                due[file] = due.get(file, 0) + size
        os.makedirs(self.folder, exist_ok=True)
        for file, size in due.items():
            found = os.stat(os.path.join(self.staging, file)).st_size
            if found != size:
                raise OSError(f"{file} has {found} bytes instead of {size}")
        for file in sorted(due):
            os.replace(os.path.join(self.staging, file), os.path.join(self.folder, file))
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


def write_period_files(
    blocks: DataFrame, order: list[str], folder: str, prefix: str = "", suffix: str = "", latest: str | None = None
) -> None:
    """Writes ``blocks`` (period, block and the columns of ``order``) as ``prefix + period + suffix``, a line
    feed behind each block. ``latest`` names a second copy of the last period of ``blocks``."""
    spark, path = blocks.sparkSession, local_path(folder)
    ensure_checkpoint_dir(spark)
    placed = (
        blocks.repartitionByRange(*order).sortWithinPartitions(*order)
        .select(
            F.coalesce(F.replace("period", F.lit("/"), F.lit("-")), F.lit(UNDATED)).alias("period"),
            F.encode(F.concat(F.coalesce("block", F.lit("")), F.lit("\n")), "UTF-8").alias("value"),
            F.spark_partition_id().alias("part"),
        )
        .checkpoint()
    )
    # from here on a row per partition and period it holds: at most partitions + periods, as they are ranges
    sizes = placed.groupBy("part", "period").agg(F.sum(F.octet_length("value")).alias("n"))
    before = Window.partitionBy("period").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("period") != UNDATED, F.col("period"))).over(Window.partitionBy(F.lit(1)))
    named = F.concat(F.lit(prefix), F.col("period"), F.lit(suffix))
    names = F.array(named)
    if latest:
        names = F.when(F.col("period") == last, F.array(named, F.lit(latest))).otherwise(names)
    starts = sizes.select("part", "period", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), names.alias("files"))
    spark.dataSource.register(PlacedFiles)
    (
        placed.join(F.broadcast(starts), ["part", "period"])  # keeps the order inside a partition
        .select(F.explode("files").alias("file"), F.col("start").cast("long").alias("start"), "value")
        .write.format(FORMAT).mode("append")
        .option("staging", os.path.join(path, f"_writing-{uuid.uuid4().hex}")).save(path)
    )
