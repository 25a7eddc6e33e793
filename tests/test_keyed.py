"""A keyed table: merges equal the plain operators, touch only their parts and leave the stored side in place."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from signalsieve.operators.dedup import insert_ignore
from signalsieve.operators.keyed import KeyedTable, merge_analysis, merge_items
from signalsieve.operators.store import upsert_analysis

ANALYSIS = "item_id long, score int, model_used string, analyzed_at timestamp"


def _table(spark, path, rows, key="item_id"):
    name = f"keyed_{uuid.uuid4().hex}"
    return KeyedTable(spark, name, str(path), rows.schema, key, parts=8, buckets=6).declare().replace(rows)


def _analysis(spark, ids, score):
    return spark.createDataFrame([(i,) for i in ids], "item_id long").select(
        "item_id", F.lit(score).alias("score"), F.lit("m").alias("model_used"),
        F.timestamp_seconds(F.coalesce("item_id", F.lit(0)) + score).alias("analyzed_at"))


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.mark.parametrize("ids", [[], [5], [None, 3, 3, 700], list(range(40, 120))])
def test_upsert_equals_the_plain_one(spark, tmp_path, ids):
    old = _analysis(spark, [None, *range(100)], 1)
    table = _table(spark, tmp_path / "t", old)
    new = _analysis(spark, ids, 2).unionByName(_analysis(spark, ids, 3))
    expected = _rows(upsert_analysis(old, new))
    for turn in range(2):  # run again after a cut: the same rows, but for null keys
        if turn == 0 or None not in ids:
            merge_analysis(table, new)
        assert _rows(table.read()) == expected
    # a later session finds the same rows
    again = KeyedTable(spark, f"keyed_{uuid.uuid4().hex}", table.path, old.schema, "item_id", 8, 6).declare()
    assert _rows(again.read()) == expected


def test_other_parts_keep_their_files(spark, tmp_path):
    table = _table(spark, tmp_path / "t", _analysis(spark, range(500), 1))
    before = _files(table.path)
    new = _analysis(spark, [7, 1007], 9)
    touched = {f"part={p}" for p in table.touched(new)}
    assert 1 <= len(touched) <= 2
    merge_analysis(table, new)
    after = _files(table.path)
    assert {f for f in before if os.path.basename(os.path.dirname(f)) not in touched} == before & after
    assert {os.path.basename(os.path.dirname(f)) for f in before ^ after} == touched
    assert len(after) <= 8 * 6  # a file a bucket, however often it is merged
    assert table.read().count() == 501


@pytest.mark.parametrize("shuffle_partitions", [4, 64])
def test_the_stored_side_is_not_shuffled(spark, tmp_path, shuffle_partitions):
    table = _table(spark, tmp_path / "t", _analysis(spark, range(500), 1))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffle_partitions)
    try:
        plan = table.merged(_analysis(spark, [1, 2], 2), True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert plan.count("Exchange hashpartitioning") == 1  # of the batch
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "Bucketed: true" in scan and "part" in scan.split("PartitionFilters: ")[1].split("]")[0]


def test_insert_ignore_equals_the_plain_one(spark, tmp_path):
    old = spark.range(60).select(F.concat(F.lit("l"), "id").alias("link"), F.col("id"), F.lit(0).alias("source_rank"),
                                 F.lit(0).alias("position"))
    batch = spark.range(40, 140).select(F.concat(F.lit("l"), (F.col("id") % 90).cast("string")).alias("link"), (F.col("id") + 1000).alias("id"),
                                        F.lit(1).alias("source_rank"), F.col("id").cast("int").alias("position"))
    table = _table(spark, tmp_path / "t", old, "link")
    expected = _rows(insert_ignore(old, batch))
    for _ in range(2):
        merge_items(table, batch)
        assert _rows(table.read()) == expected
    assert _rows(table.lookup(batch.where("id < 1043"))) == sorted([(f"l{i}", i, 0, 0) for i in range(40, 43)], key=repr)
