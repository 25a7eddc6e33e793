"""The stored tables, read with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from signalsieve import schemas


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table by explicit schema: no inference job, absent columns read as null."""
    return spark.read.schema(schema).parquet(path)


def scan_items(spark: SparkSession, path: str) -> DataFrame:
    return schemas.conform(read_table(spark, path, schemas.ITEMS), schemas.ITEMS)


def scan_analysis(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.ANALYSIS)


INPUT_PARTITIONS = "spark.signalsieve.inputPartitions"


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over as many partitions as the setting INPUT_PARTITIONS states; as it is where it is unset.

    For machines with more cores than a small table has splits. At scale leave it unset: scans have
    splits enough, and nothing is shuffled.
    """
    parts = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(parts)) if parts else df
