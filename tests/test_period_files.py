"""One file per period: whole, in order, written by several tasks, untouched by failed jobs."""

import os
import xml.etree.ElementTree as ET
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signalsieve.plans import reports as P
from signalsieve.plans.files import PlacedFilesWriter, local_path, write_period_files
from tests.test_store import items

NOW = datetime(2024, 1, 20, 12)


def test_feed_files_are_whole(spark, tmp_path):
    days = [dict(id=i, title=f"t{i} <&>\x01", content="ü" * (i % 7), full_content="",
                 created_at=datetime(2024, 1, 7, 16) + timedelta(hours=i)) for i in range(30)]
    blocks = P.report_rss(items(spark, days), P.DAILY, "https://example.org", NOW)
    folder = tmp_path / "rss"
    for _ in range(2):  # a second run replaces the files
        P.write_rss_files(blocks, str(folder), P.DAILY)
        assert sorted(os.listdir(folder)) == ["daily_rss_2024-01-08.xml", "daily_rss_2024-01-09.xml", "latest_daily_rss.xml"]
    for name, ids in (("daily_rss_2024-01-08.xml", range(23, -1, -1)), ("daily_rss_2024-01-09.xml", range(29, 23, -1)),
                      ("latest_daily_rss.xml", range(29, 23, -1))):
        channel = ET.parse(folder / name).getroot().find("channel")
        assert [i.findtext("title") for i in channel.findall("item")] == [f"t{i} <&>�" for i in ids]
    read = spark.read.option("rowTag", "item").xml(str(folder / "daily_rss_2024-01-08.xml"))
    assert read.count() == 24


def test_markdown_file_equals_its_blocks(spark, tmp_path):
    df = items(spark, [dict(id=i, title=f"t{i}", created_at=NOW - timedelta(hours=i)) for i in range(50)])
    blocks = P.report_markdown(df, P.ALLTIME, NOW)
    P.write_markdown_files(blocks, str(tmp_path), P.ALLTIME)
    expected = "".join(r.block + "\n" for r in blocks.orderBy(*P.BLOCK_ORDER).collect())
    assert (tmp_path / "Alltime_all.md").read_text() == expected


def test_one_period_over_many_tasks(spark, tmp_path):
    """A period far larger than a partition, many small ones, and rows without a period."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") < 12_000, "big").when(F.col("id") < 19_990, F.concat(F.lit("p"), (F.col("id") % 40).cast("string")))
        .alias("period"), "id", F.concat(F.col("id").cast("string"), F.repeat(F.lit("é"), (F.col("id") % 50).cast("int"))).alias("block"))
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")
    try:
        write_period_files(rows, ["period", "id"], f"file:{tmp_path}", suffix=".txt", latest="last.txt")
    finally:
        spark.conf.unset(conf)
    found = {}
    for r in rows.orderBy("id").collect():
        found.setdefault(r.period or "undated", []).append(r.block + "\n")
    assert sorted(os.listdir(tmp_path)) == sorted([f"{p}.txt" for p in found] + ["last.txt"])
    for period, lines in found.items():
        assert (tmp_path / f"{period}.txt").read_text() == "".join(lines)
    assert (tmp_path / "last.txt").read_text() == "".join(found["p9"])


def _batch(*rows):
    files, starts, values = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(files), pa.array(starts, pa.int64()), pa.array(values, pa.binary())],
                                      names=["file", "start", "value"])


def test_repeated_tasks_and_failed_jobs(tmp_path):
    folder, staging = str(tmp_path / "out"), str(tmp_path / "out" / "_writing-1")
    writer = PlacedFilesWriter(folder, staging)
    head, tail = [_batch(("a", 0, b"one\n"), ("a", 0, b"two\n"))], [_batch(("a", 8, b"three\n"), ("b", 0, b"x"))]
    late = writer.write(iter(tail))
    writer.write(iter([_batch(("a", 0, b"on"))]))  # an attempt that stopped
    first, again = writer.write(iter(head)), writer.write(iter(head))
    assert first == again and not os.path.exists(os.path.join(folder, "a"))
    writer.commit([first, late, None])
    assert open(os.path.join(folder, "a"), "rb").read() == b"one\ntwo\nthree\n" and sorted(os.listdir(folder)) == ["a", "b"]

    failed = PlacedFilesWriter(folder, staging)
    failed.write(iter([_batch(("a", 0, b"new"))]))
    failed.abort([])
    assert open(os.path.join(folder, "a"), "rb").read() == b"one\ntwo\nthree\n" and sorted(os.listdir(folder)) == ["a", "b"]

    short = PlacedFilesWriter(folder, staging)
    part = short.write(iter([_batch(("a", 5, b"new"))]))
    with pytest.raises(OSError):  # bytes before it are missing
        short.commit([part])
    assert open(os.path.join(folder, "a"), "rb").read() == b"one\ntwo\nthree\n"


def test_no_rows_and_other_file_systems(spark, tmp_path):
    write_period_files(spark.createDataFrame([], "period string, block string"), ["period"], str(tmp_path / "none"))
    assert not (tmp_path / "none").exists() or os.listdir(tmp_path / "none") == []
    assert local_path("file:///a/b") == local_path("file:/a/b") == "/a/b"
    with pytest.raises(ValueError):
        local_path("hdfs://host/a")
