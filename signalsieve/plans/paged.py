"""Tables kept in reading order, with an index of which file holds which row numbers.

``write_paged`` sorts a table once; after that any page is read from the files that hold it, whatever the size
of the table. Rows that tie in ``order`` get some order among themselves, the same for every reader of one
written table. A table is complete once its index is written; a new state goes to a new path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_PER_FILE = 100_000


def write_paged(rows: DataFrame, order: list[Column], path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Writes ``rows`` below ``path`` in ``order``, in files of at most ``rows_per_file``, and then their index.

    Files are numbered by range partition and by place in it, so that the order of the names' numbers is the
    order of the rows. The counts come from the files' footers; the window below has one row per file.
    """
    (rows.repartitionByRange(*order).sortWithinPartitions(*order)
     .write.option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows"))
    name = F.col("_metadata.file_name")
    counts = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows").groupBy(name.alias("file")).agg(
        F.count(F.lit(1)).alias("n"))
    place = [F.regexp_extract("file", r"^part-(\d+)", 1).cast("int"), F.regexp_extract("file", r"-c(\d+)\.", 1).cast("int")]
    before = Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    index = counts.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), "n")
    index.write.parquet(f"{path}/index")


def _index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file string, before long, n long").parquet(f"{path}/index")


def count_rows(spark: SparkSession, path: str) -> int:
    """Rows of a written table, from its index alone."""
    return _index(spark, path).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def count_pages(spark: SparkSession, path: str, page_rows: int) -> int:
    return -(-count_rows(spark, path) // page_rows)


def read_numbered(spark: SparkSession, path: str, page_rows: int) -> DataFrame:
    """All rows with ``row_number`` and ``page``, in one scan: no sort, and no shuffle of the rows where the index
    (one row per file) is small enough to be sent to them. Filters on other columns reach the scan."""
    stored = spark.read.parquet(f"{path}/rows")
    rows = stored.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    index = _index(spark, path).select(F.col("file").alias("_file"), F.col("before").alias("_before"))
    number = F.col("_before") + F.col("_place") + 1
    return rows.join(index, "_file").select(
        *stored.columns, number.alias("row_number"), F.ceil(number / F.lit(page_rows)).cast("long").alias("page"))


def read_page(spark: SparkSession, path: str, page: int, page_rows: int) -> DataFrame:
    """The rows of page 1, 2, ... with ``row_number`` and ``page``; none behind the last page.

    Every file holds a row at least, so a page lies in ``page_rows`` files at most, and mostly in one.
    """
    if page < 1 or page_rows < 1:
        raise ValueError("pages and their rows are counted from 1")
    first, last = (page - 1) * page_rows, page * page_rows
    held = _index(spark, path).where((F.col("before") < last) & (F.col("before") + F.col("n") > first)).collect()
    if not held:
        none = spark.read.parquet(f"{path}/rows").limit(0)
        return none.withColumn("row_number", F.lit(0).cast("long")).withColumn("page", F.lit(page).cast("long"))
    before = F.create_map(*[F.lit(x) for r in held for x in (r["file"], r["before"])])
    rows = spark.read.parquet(*[f"{path}/rows/{r['file']}" for r in held])
    number = before[F.col("_metadata.file_name")] + F.col("_metadata.row_index") + 1
    return rows.withColumn("row_number", number).where(F.col("row_number").between(first + 1, last)).withColumn(
        "page", F.lit(page).cast("long"))
