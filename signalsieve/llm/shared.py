"""Folders that driver and executors share, and intermediate tables written there."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

WHITE = r"\x20\x09-\x0D"
WORD = rf"[^{WHITE}]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where none is named, a local session (tests)
    gets one of its own; a cluster session is an error, because its machines share no local folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    folder = folder or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="sieve-llm-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and safe from lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Smaller Arrow batches for what runs inside: whole texts are large, and a batch is held twice."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release_memory() -> None:
    """Gives freed memory of Arrow's pool and of the C heap back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not every C library can


def releasing(run: Callable) -> Callable:
    """A function for ``mapInArrow`` whose worker keeps no freed memory from one task to the next."""

    @wraps(run)
    def released(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return released


def cut(df: DataFrame) -> DataFrame:
    """A small table with its lineage cut. Written, not checkpointed: a checkpoint keeps the constraints of
    its plan, which multiply from turn to turn of a loop."""
    return written(df, "cut")
