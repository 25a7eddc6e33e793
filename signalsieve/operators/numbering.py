"""Row numbers over a whole table without one task that sees every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from signalsieve.session import ensure_checkpoint_dir


def number_rows(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """Adds 1..N in the given total order.

    The rows are range-partitioned and sorted; each learns its place in its own partition,
    and a table of partition sizes (one row per partition) supplies the offset. The sorted
    rows are checkpointed first, because both the sizes and the rows must come from the
    very same split. Project ``df`` to what is needed before calling this.
    """
    ensure_checkpoint_dir(df.sparkSession)
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_pid", F.shiftright("_mid", 33))
        .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mid")
        .checkpoint()
    )
    # one row per shuffle partition, so the window below is small whatever the data size
    sizes = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        placed.join(F.broadcast(offsets), "_pid")
        .withColumn(name, (F.col("_offset") + F.col("_pos") + 1).cast("long"))
        .drop("_pid", "_pos", "_offset")
    )
