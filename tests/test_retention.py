from datetime import datetime, timedelta

from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from signalsieve.streaming.retention import DayTable, write_retained

NOW = datetime(2024, 1, 20, 12)
SCHEMA = StructType([StructField("id", LongType()), StructField("created_at", TimestampType()), StructField("day_no", LongType())])


def rows(spark, days):
    return spark.createDataFrame([(d, None if d is None else NOW - timedelta(days=d, seconds=s), s) for d in days for s in (0, 1)], SCHEMA)


def kept(table):
    return sorted((r.id, r.day_no) for r in table.read().collect() if r.id is not None)


def test_expired_days_are_not_opened(spark, tmp_path):
    table = DayTable(spark, str(tmp_path), SCHEMA)
    assert table.read().count() == 0 and table.kept_from() is None and table.vacuum() == 0
    table.write(rows(spark, [0, 5, 10, 11, None]), 0)
    table.write(rows(spark, [1, 12]), 1)
    assert table.read().count() == 14
    assert table.expiring(10, NOW).count() == 5  # one second of day 10, and days 11 and 12
    table.expire(10, NOW, 1)
    want = [(d, s) for d in (0, 1, 5) for s in (0, 1)] + [(10, 0)]
    assert kept(table) == sorted(want) and table.read().filter("id IS NULL").count() == 2
    # files of expired days may hold anything
    spoiled = [p for p in tmp_path.rglob("*.parquet") if p.parent.name in ("day=2024-01-09", "day=2024-01-08")]
    for path in spoiled:
        path.write_bytes(b"not a table")
    assert len(spoiled) >= 2 and kept(table) == sorted(want)
    files = {p for p in tmp_path.rglob("*.parquet") if p not in spoiled}
    table.expire(4, NOW - timedelta(days=7), 2)  # an older moment than the last: no way back
    assert kept(table) == sorted(want) and files <= set(tmp_path.rglob("*.parquet"))
    table.expire(0, NOW, 3)
    assert kept(table) == sorted(want)
    assert table.expiring(5, NOW).count() == 2  # one row of day 10, one of day 5; nothing that went before


def test_vacuum_deletes_whole_days_only(spark, tmp_path):
    table = DayTable(spark, str(tmp_path), SCHEMA)
    table.write(rows(spark, [0, 5, 11]), 0)
    table.write(rows(spark, [11, 12]), 1)
    table.expire(5, NOW, 1)
    before = kept(table)
    assert table.vacuum() == 3 and kept(table) == before == [(0, 0), (0, 1), (5, 0)]
    days = {p.parent.name for p in tmp_path.rglob("*.parquet") if p.parent.name.startswith("day=")}
    assert days == {"day=2024-01-20", "day=2024-01-15"}


def test_stream_goes_on_while_days_expire(spark, tmp_path):
    landed, folder = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(landed)
    for turn, days in enumerate(([0, 9, 12], [1, 10])):
        rows(spark, days).coalesce(1).write.mode("append").parquet(landed)
        write_retained(stream, folder, 10, lambda n: NOW + timedelta(days=n)).awaitTermination()
        table = DayTable(spark, folder, SCHEMA)
        assert kept(table) == ([(0, 0), (0, 1), (9, 0), (9, 1)] if turn == 0 else [(0, 0), (0, 1), (1, 0), (1, 1), (9, 0)])
        table.vacuum()
    # a replayed batch writes the same again
    table.write(rows(spark, [1, 10]), 1)
    assert kept(table) == [(0, 0), (0, 1), (1, 0), (1, 1), (9, 0)]
