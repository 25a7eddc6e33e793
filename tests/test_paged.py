"""Pages of stored tables against row numbers over the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from signalsieve.plans import reports as P
from signalsieve.plans.paged import count_pages, count_rows, read_page, write_paged


def items(spark, n):
    rng = random.Random(n)
    return (spark.range(n).repartition(7).withColumn("title", F.concat(F.lit("T"), (F.col("id") * 7919 % 101).cast("string")))
            .withColumn("link", F.lit("l")).withColumn("content", F.when(F.col("id") % 3 == 0, "body"))
            .withColumn("site_name", F.when(F.col("id") % 5 > 0, F.concat(F.lit("s"), F.col("id") % rng.randrange(2, 9))))
            .withColumn("created_at", F.when(F.col("id") % 11 > 0, F.timestamp_seconds(F.col("id") * 31 % 977))))


@pytest.mark.parametrize("sort,asc", [("", True), ("title", False), ("source", True), ("time", True)])
def test_pages_agree_with_the_numbered_table(spark, tmp_path, sort, asc):
    rows, path = items(spark, 733), str(tmp_path / "t")
    P.write_report_table(rows, path, sort=sort, asc=asc, rows_per_file=40)
    want = sorted(tuple(r) for r in P.report_table(rows, sort=sort, asc=asc).select("row_number", "page", "id").collect())
    got = [tuple(r) for k in range(1, count_pages(spark, path, 50) + 1)
           for r in P.report_page(spark, path, k).select("row_number", "page", "id").collect()]
    assert sorted(got) == want and len(want) == 733 == count_rows(spark, path)
    whole = P.report_pages(spark, path)
    assert sorted(tuple(r) for r in whole.select("row_number", "page", "id").collect()) == want
    assert "Exchange hash" not in whole._jdf.queryExecution().toString()
    assert P.report_page(spark, path, 16).count() == 0


def test_rows_of_the_second_table(spark, tmp_path):
    rows, path = items(spark, 300), str(tmp_path / "t")
    P.write_report_table_rows(rows, path)
    want = P.report_table_rows(rows).where("row_number BETWEEN 101 AND 150")
    got = P.report_page(spark, path, 3)
    assert sorted(map(str, got.drop("page").collect())) == sorted(map(str, want.collect()))


def test_files_read_for_a_page_do_not_grow(spark, tmp_path):
    for n in (2_000, 20_000):
        path = str(tmp_path / str(n))
        write_paged(items(spark, n), [F.col("id").asc()], path, rows_per_file=400)
        for page in (1, 17, n // 50):
            rows = read_page(spark, path, page, 50)
            assert len(rows.inputFiles()) <= 2
            assert sorted(r.id for r in rows.collect()) == list(range((page - 1) * 50, page * 50))


def test_rows_of_equal_keys_and_extra_columns_are_whole(spark, tmp_path):
    rows = spark.range(500).select("id", F.lit(1).alias("n"), F.lit("x").alias("file"), F.lit(2).alias("before"))
    write_paged(rows, [F.col("n").asc()], str(tmp_path / "t"), rows_per_file=64)
    seen = [r for k in range(1, 6) for r in read_page(spark, str(tmp_path / "t"), k, 100).collect()]
    assert sorted(r.id for r in seen) == list(range(500)) == sorted(r.row_number - 1 for r in seen)


def test_empty_table_and_wrong_pages(spark, tmp_path):
    write_paged(items(spark, 0), [F.col("id").asc()], str(tmp_path / "t"))
    got = read_page(spark, str(tmp_path / "t"), 1, 50)
    assert got.count() == 0 and got.columns[-2:] == ["row_number", "page"]
    assert count_rows(spark, str(tmp_path / "t")) == count_pages(spark, str(tmp_path / "t"), 50) == 0
    with pytest.raises(ValueError):
        read_page(spark, str(tmp_path / "t"), 0, 50)
