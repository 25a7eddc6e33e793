import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from signalsieve.operators.alerts import Channel
from signalsieve.streaming.cycle import CycleSettings, identified, run_cycle, stream_cycle
from signalsieve.streaming.links import LinkIndex, first_rows_of_batch, read_first_rows, write_first_rows
from signalsieve.streaming.store import TABLES, Store
from signalsieve.streaming.windows import (
    read_counts, read_side, read_split_metrics, stream_counts, stream_dedup, stream_retention, write_counts, write_split,
)

NOW = datetime(2024, 1, 20, 12)
SCHEMA = ("title string, link string, pub_date string, author string, category string, content string, full_content string, "
          "download_links array<string>, site_name string, source_rank int, position int")


def land(spark, folder, rows):
    full = [(t, link, pub, "", "", "", "", [], "leakbase", rank, i) for i, (t, link, pub, rank) in enumerate(rows)]
    spark.createDataFrame(full, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    return identified(stream, F.timestamp_seconds(F.lit(int((NOW - datetime(1970, 1, 1)).total_seconds()))))


HOT = "fresh database of 5 million users email password"


def test_cycle_over_two_batches(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "store")
    settings = CycleSettings(clock=lambda n: NOW, channels=(Channel("t", "text"),))
    store = Store(spark, root)
    land(spark, folder, [(HOT, "l1", "", 1), (HOT + " later copy", "l1", "", 2), ("combolist", "l2", "", 0),
                         (HOT, "l3", "2024-01-01T00:00:00Z", 0)])
    stream_cycle(source(spark, folder), store, settings).awaitTermination()
    assert sorted(r.link for r in store.read("items").collect()) == ["l1", "l2", "l3"]
    assert store.read("analysis").count() == 1  # l2 is skipped by title, l3 is stale
    [out] = store.read("outbox").collect()
    assert (out.link, out.kind, out.score) == ("l1", "urgent", 10) and out.title == HOT
    land(spark, folder, [(HOT, "l1", "", 0), (HOT, "l4", "", 0)])
    stream_cycle(source(spark, folder), store, settings).awaitTermination()
    assert sorted(r.link for r in store.read("items").collect()) == ["l1", "l2", "l3", "l4"]
    assert sorted(r.link for r in store.read("outbox").collect()) == ["l1", "l4"]
    assert store.read("notified").count() == 2


def test_replayed_batch_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "in")
    land(spark, folder, [(HOT, "l1", "", 0), ("quiet", "l2", "", 0)])
    batch = identified(spark.read.schema(SCHEMA).parquet(folder), F.lit(NOW.isoformat()).cast("timestamp"))
    store = Store(spark, str(tmp_path / "store")).create()
    settings = CycleSettings(clock=lambda n: NOW)
    tables = tuple(TABLES)

    def state():
        return {t: sorted(map(str, store.read(t).collect())) for t in tables}

    run_cycle(batch, 0, store, settings)
    first = state()
    run_cycle(batch, 0, store, settings)
    assert state() == first
    run_cycle(batch, 1, store, settings)
    second = state()
    assert {t: v for t, v in second.items() if t not in ("counters", "cycles")} == {
        t: v for t, v in first.items() if t not in ("counters", "cycles")}
    seen = [r for r in store.read("counters").collect() if not r.new]
    assert [(r.site_name, r.fetched, r.stale, r.fresh) for r in seen] == [("leakbase", 2, 0, 0)]
    run_cycle(batch, 1, store, settings)
    assert state() == second


def test_missed_urgent_items_are_sent_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    land(spark, folder, [(HOT, "l1", "", 0)])
    batch = identified(spark.read.schema(SCHEMA).parquet(folder), F.lit(NOW.isoformat()).cast("timestamp"))
    store = Store(spark, str(tmp_path / "store")).create()
    run_cycle(batch, 0, store, CycleSettings(clock=lambda n: NOW, notify_min_score=11))
    assert store.read("outbox").count() == 0
    for n in (1, 2):
        run_cycle(batch, n, store, CycleSettings(clock=lambda n: NOW))
    [row] = store.read("outbox").collect()
    assert row.title == "[leakbase] " + HOT and row.kind == "urgent"


def test_pruned_copy(spark, tmp_path):
    folder = str(tmp_path / "in")
    land(spark, folder, [(HOT, "l1", "", 0)])
    batch = identified(spark.read.schema(SCHEMA).parquet(folder), F.lit(NOW.isoformat()).cast("timestamp"))
    store = Store(spark, str(tmp_path / "store")).create()
    run_cycle(batch, 0, store, CycleSettings(clock=lambda n: NOW))
    kept = store.pruned_copy(str(tmp_path / "kept"), 90, NOW)
    assert kept.read("items").count() == kept.read("analysis").count() == kept.read("notified").count() == 1
    gone = store.pruned_copy(str(tmp_path / "gone"), 90, NOW + timedelta(days=91))
    assert gone.read("items").count() == gone.read("analysis").count() == gone.read("notified").count() == 0


def events(spark, folder, rows):
    spark.createDataFrame(rows, "link string, created_at timestamp, site_name string").coalesce(1).write.mode("append").parquet(folder)


def drain(stream, folder):
    run = (stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp")
           .outputMode("append").trigger(availableNow=True).start())
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def test_dedup_across_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    events(spark, folder, [("a", NOW, "s"), ("a", NOW, "s"), ("b", NOW, "s")])
    events(spark, folder, [("a", NOW + timedelta(days=1), "s"), ("c", NOW, "s")])
    stream = (spark.readStream.schema("link string, created_at timestamp, site_name string")
              .option("maxFilesPerTrigger", 1).parquet(folder))
    out = drain(stream_dedup(stream).select("link"), str(tmp_path / "o"))
    assert sorted(r.link for r in out.collect()) == ["a", "b", "c"]


def test_local_day_and_week_edges(spark, tmp_path):
    rows = [("a", datetime(2024, 1, 7, 15, 59, 59), "s"), ("b", datetime(2024, 1, 7, 16), "s"), ("c", datetime(2024, 1, 14, 15, 59, 59), "s"),
            ("d", datetime(2024, 1, 14, 16), "s")]
    df = spark.createDataFrame(rows, "link string, created_at timestamp, site_name string")
    days = {str(r.window_start): r.n for r in stream_counts(df).collect()}
    assert days == {"2024-01-06 16:00:00": 1, "2024-01-07 16:00:00": 1, "2024-01-13 16:00:00": 1, "2024-01-14 16:00:00": 1}
    weeks = {str(r.window_start): r.n for r in stream_counts(df, "weekly").collect()}
    assert weeks == {"2023-12-31 16:00:00": 1, "2024-01-07 16:00:00": 2, "2024-01-14 16:00:00": 1}
    utc = {str(r.window_start): r.n for r in stream_counts(df, "weekly", tz_offset_hours=0).collect()}
    assert utc == {"2024-01-01 00:00:00": 2, "2024-01-08 00:00:00": 2}
    west = {str(r.window_start): r.n for r in stream_counts(df, "weekly", tz_offset_hours=-5).collect()}
    assert set(west) == {"2024-01-01 05:00:00", "2024-01-08 05:00:00"}


def test_late_rows_do_not_reopen_windows(spark, tmp_path):
    folder = str(tmp_path / "in")
    events(spark, folder, [("a", datetime(2024, 1, 1), "s"), ("b", datetime(2024, 1, 5), "s")])
    stream = spark.readStream.schema("link string, created_at timestamp, site_name string").parquet(folder)
    counts = stream_counts(stream)
    first = drain(counts, str(tmp_path / "o"))
    assert [(str(r.window_end), r.n) for r in first.collect()] == [("2024-01-01 16:00:00", 1)]
    events(spark, folder, [("late", datetime(2024, 1, 1), "s"), ("c", datetime(2024, 1, 9), "s")])
    rows = drain(counts, str(tmp_path / "o")).collect()
    assert sorted((str(r.window_end), r.n) for r in rows) == [("2024-01-01 16:00:00", 1), ("2024-01-05 16:00:00", 1)]


def test_late_rows_count_and_open_windows_show(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "o")
    schema = "link string, created_at timestamp, site_name string"
    for rows in ([("a", datetime(2024, 1, 1), "s"), ("b", datetime(2024, 1, 5), "s")],
                 [("late", datetime(2024, 1, 1), "s"), ("c", datetime(2024, 1, 9), "s")]):
        events(spark, folder, rows)
        write_counts(spark.readStream.schema(schema).parquet(folder), out).awaitTermination()
    got = sorted((str(r.window_end), r.n) for r in read_counts(spark, out).collect())
    assert got == [("2024-01-01 16:00:00", 2), ("2024-01-05 16:00:00", 1), ("2024-01-09 16:00:00", 1)]


def test_nothing_read_before_the_first_batch(spark, tmp_path):
    assert read_counts(spark, str(tmp_path)).count() == 0
    assert read_first_rows(spark, str(tmp_path), LINKS).count() == 0


def test_retention(spark):
    df = spark.createDataFrame([("a", NOW - timedelta(days=10), "s"), ("b", NOW - timedelta(days=11), "s")],
                               "link string, created_at timestamp, site_name string")
    assert [r.link for r in stream_retention(df, 10, NOW).collect()] == ["a"]
    assert stream_retention(df, 0, NOW).count() == 2


LINKS = "link string, source_rank int, position long, site_name string"


def link_rows(spark, rows):
    return spark.createDataFrame([(link, rank, pos, f"s{rank}") for link, rank, pos in rows], LINKS)


def test_smallest_row_of_a_link_wins_whenever_it_comes(spark, tmp_path):
    """Late duplicates, replays, nulls, and a compaction in between."""
    rng = random.Random(4)
    rows = [(rng.choice([None, "", *"abcdefghij"]), rng.randrange(5), i) for i in range(200)]
    rng.shuffle(rows)
    folder, order = str(tmp_path), ("source_rank", "position")
    index = LinkIndex(spark, f"{folder}/links", order, buckets=4)
    best = {}
    for n in range(4):
        part = rows[50 * n : 50 * n + 50]
        for turn in range(1 + (n == 2)):  # the third batch is replayed
            first_rows_of_batch(link_rows(spark, part), n, folder, index, NOW + timedelta(days=n))
        for link, rank, pos in part:
            best[link] = min(best.get(link, (9, 0)), (rank, pos))
        found = read_first_rows(spark, folder, LINKS).collect()
        assert len(found) == len(best) and {r.link: (r.source_rank, r.position) for r in found} == best
        if n == 1:
            index.compact(1)
            written = index.spark.read.parquet(f"{folder}/links/versions/batch_id=1").count()
            assert written == len(best)


def test_stream_of_first_rows(spark, tmp_path):
    folder = str(tmp_path / "in")
    for rows in ([("a", 3, 0), ("b", 1, 1), ("a", 2, 5)], [("a", 1, 9), ("b", 2, 0), ("c", 0, 0)]):
        link_rows(spark, rows).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(LINKS).option("maxFilesPerTrigger", 1).parquet(folder)
    write_first_rows(stream, str(tmp_path / "out"), lambda n: NOW, buckets=8).awaitTermination()
    found = read_first_rows(spark, str(tmp_path / "out"), LINKS).collect()
    assert {(r.link, r.source_rank, r.position) for r in found} == {("a", 1, 9), ("b", 1, 1), ("c", 0, 0)}


def test_a_batch_reads_only_the_buckets_of_its_links(spark, tmp_path):
    """Files of all other buckets may hold anything: they are never opened."""
    index = LinkIndex(spark, str(tmp_path), (), buckets=16)
    links = spark.createDataFrame([(f"l{i}",) for i in range(100)], "link string")
    index.add(links, 0, NOW)
    index.compact(0)
    index.add(spark.createDataFrame([(f"m{i}",) for i in range(100)], "link string"), 1, NOW)
    batch = spark.createDataFrame([("l7",), ("m9",), ("new",)], "link string")
    wanted = {f"bucket={b}" for b in index.touched(batch)}
    spoiled = 0
    for path in tmp_path.rglob("*.parquet"):
        if path.parent.name.startswith("bucket=") and path.parent.name not in wanted:
            path.write_bytes(b"not a table")
            spoiled += 1
    assert spoiled > 16 and len(wanted) <= 3
    assert sorted(r.link for r in index.known(batch, before=2).collect()) == ["l7", "m9"]
    assert sorted(r.link for r in index.known(batch, before=1).collect()) == ["l7"]


def test_index_forgets_links_that_were_not_seen_lately(spark, tmp_path):
    index = LinkIndex(spark, str(tmp_path), (), buckets=4)
    for n, names in enumerate(("ab", "bc", "d")):
        index.add(spark.createDataFrame([(x,) for x in names], "link string"), n, NOW + timedelta(days=n))
    index.compact(1, seen_since=NOW + timedelta(days=1))
    everything = spark.createDataFrame([(x,) for x in "abcde"], "link string")
    assert sorted(r.link for r in index.known(everything, before=3).collect()) == ["b", "c", "d"]


def test_store_without_an_index_gets_one(spark, tmp_path):
    """Tables of an earlier version: items, analysis, outbox and notified only."""
    batch = land_batch(spark, tmp_path, [(HOT, "l1", "", 0), ("quiet", "l2", "", 0)])
    old = Store(spark, str(tmp_path / "old")).create()
    run_cycle(batch, 0, old, CycleSettings(clock=lambda n: NOW, notify_min_score=11))
    store = Store(spark, str(tmp_path / "store"))
    for table in ("items", "analysis", "outbox", "notified"):
        store.write(table, old.read(table), 0)
    store.create()
    run_cycle(batch, 1, store, CycleSettings(clock=lambda n: NOW))
    assert store.read("items").count() == 2
    assert [r.title for r in store.read("outbox").collect()] == ["[leakbase] " + HOT]


def land_batch(spark, tmp_path, rows):
    folder = str(tmp_path / "in")
    land(spark, folder, rows)
    return identified(spark.read.schema(SCHEMA).parquet(folder), F.lit(NOW.isoformat()).cast("timestamp"))


def test_notices_are_sent_once_a_period(spark, tmp_path):
    batch = land_batch(spark, tmp_path, [(HOT, "l1", "", 0), ("quiet", "l2", "", 0)])
    store = Store(spark, str(tmp_path / "store")).create()
    # Saturday noon, the same local day, and the next one
    times = [NOW, NOW + timedelta(hours=2), NOW + timedelta(days=1)]
    settings = CycleSettings(clock=lambda n: times[n], daily_notice=True, weekly_notice_on=5,
                             channels=(Channel("t", "text"), Channel("e", "embed", send_daily=False)))
    for n in (0, 0, 1, 2, 2):
        run_cycle(batch, n, store, settings)
    rows = {(r.kind, r.period, r.channel): r.body for r in store.read("notices").collect()}
    assert store.read("notices").count() == len(rows) == 4
    assert rows["daily", "2024-01-20", "t"].startswith("2 leak items") and HOT in rows["daily", "2024-01-20", "t"]
    assert rows["daily", "2024-01-21", "t"] == "0 leak items collected"
    assert rows["weekly", "2024-01-15_2024-01-21", "t"] == rows["weekly", "2024-01-15_2024-01-21", "e"] == "2 leak items collected"


def test_providers_answer_before_the_rules(spark, tmp_path):
    good = '{"score": 9, "category": "access_sale", "summary": "m", "is_urgent": true}'

    def providers(items):
        answers = [(0, "first", '{"score": 99}'), (1, "second", good)]
        each = F.explode(F.array(*(F.struct(F.lit(o).alias("ord"), F.lit(p).alias("provider"), F.lit(j).alias("json")) for o, p, j in answers)))
        return items.filter("link = 'l1'").select(F.col("id").alias("item_id"), each.alias("a")).select(
            "item_id", "a.provider", "a.ord", "a.json", F.lit(None).cast("string").alias("error"))

    batch = land_batch(spark, tmp_path, [(HOT, "l1", "", 0), (HOT, "l4", "", 0)])
    store = Store(spark, str(tmp_path / "store")).create()
    run_cycle(batch, 0, store, CycleSettings(clock=lambda n: NOW, providers=providers))
    links = {r.id: r.link for r in store.read("items").collect()}
    models = {links[r.item_id]: (r.model_used, r.score) for r in store.read("analysis").collect()}
    assert models["l1"] == ("second", 9) and models["l4"][0] == "rules-engine"
    assert store.read("answers").count() == 2
    assert {r.category for r in store.read("outbox").collect() if r.link == "l1"} == {"access_sale"}


def test_without_analysis_every_fresh_item_is_a_message(spark, tmp_path):
    batch = land_batch(spark, tmp_path, [(HOT, "l1", "", 0), ("quiet", "l2", "", 0), (HOT, "l3", "2024-01-01T00:00:00Z", 0)])
    store = Store(spark, str(tmp_path / "store")).create()
    run_cycle(batch, 0, store, CycleSettings(clock=lambda n: NOW, analyze=False))
    assert sorted(r.link for r in store.read("outbox").collect()) == ["l1", "l2"]
    assert store.read("analysis").count() == 0 and store.read("items").count() == 3


def test_late_and_timely_rows_are_two_outputs(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id long, pub_date string, created_at timestamp"

    def land_rows(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

    def run(at=out):
        write_split(spark.readStream.schema(schema).parquet(folder), at, 7).awaitTermination()

    old, new = "2024-01-01T00:00:00Z", "2024-01-19T00:00:00Z"
    typed = spark.createDataFrame([], schema).schema
    assert read_side(spark, out, typed, True).count() == read_split_metrics(spark, out, 7).count() == 0
    land_rows((1, old, NOW), (2, new, NOW), (3, None, NOW), (4, "no date", None))
    run()
    land_rows((5, old, NOW - timedelta(days=3)), (6, new, NOW - timedelta(days=3)))
    run()
    assert sorted(r.id for r in read_side(spark, out, typed, True).collect()) == [1, 5]
    timely = read_side(spark, out, typed, False)
    assert sorted(r.id for r in timely.collect()) == [2, 3, 4, 6] and timely.columns == ["id", "pub_date", "created_at"]
    assert "PartitionFilters: [isnotnull(late" in timely._jdf.queryExecution().toString()
    limit = NOW - timedelta(days=7)  # a batch of older rows does not move it back
    assert sorted((r.batch, r.n, r.n_late, r.watermark) for r in read_split_metrics(spark, out, 7).collect()) == [
        (0, 4, 1, limit), (1, 2, 1, limit)]
    # the last batch again, as after a failure before its commit
    (tmp_path / "out" / "checkpoint" / "commits" / "1").unlink()
    (tmp_path / "out" / "checkpoint" / "commits" / ".1.crc").unlink(missing_ok=True)
    run()
    assert sorted(r.id for r in read_side(spark, out, typed, True).collect()) == [1, 5]
    assert read_split_metrics(spark, out, 7).count() == 2


def names(spark, *links):
    return spark.createDataFrame([(x,) for x in links], "link string")


def test_few_runs_however_many_batches(spark, tmp_path, monkeypatch):
    """Runs of a level become one of the next; files of runs that went into another are never opened again."""
    monkeypatch.setattr("signalsieve.streaming.links.FAN", 2)
    index = LinkIndex(spark, str(tmp_path), (), buckets=64)
    for n in range(7):
        index.add(names(spark, f"l{n}", f"m{n}"), n, NOW)
        if n == 3:
            index.add(names(spark, "l3", "m3"), n, NOW)  # a replay of the batch with which two levels were filled
        assert sum(2**r.level for r in index._runs(n + 1)) == n + 1
    assert [r.level for r in index._runs(7)] == [2, 1, 0]
    kept = {r.folder for n in (5, 7) for r in index._runs(n)}  # 5: for compact below
    for folder in (tmp_path / "runs").iterdir():
        if f"runs/{folder.name}" not in kept:
            for path in folder.rglob("*.parquet"):
                path.write_bytes(b"not a table")
    everything = names(spark, *(f"{x}{n}" for x in "lm" for n in range(9)))
    assert sorted(r.link for r in index.known(everything, before=7).collect()) == [f"{x}{n}" for x in "lm" for n in range(7)]
    index.compact(4)  # in the middle of a run
    index.add(names(spark, "l8"), 9, NOW)  # the numbers have a gap
    assert sorted(r.link for r in index.known(names(spark, "l4", "m6", "l7", "l8"), before=20).collect()) == ["l4", "l8", "m6"]


def test_index_of_an_earlier_layout_is_read_on(spark, tmp_path):
    """Formerly each batch had a folder a bucket and nothing listed the batches."""
    index = LinkIndex(spark, str(tmp_path), (), buckets=4)
    for n, x in enumerate("ab"):
        old = names(spark, x).withColumns({"seen": F.lit(NOW), "bucket": index._bucket(F.col("link"))})
        old.write.partitionBy("bucket").parquet(f"{tmp_path}/batches/batch_id={n}")
    index.add(names(spark, "c"), 2, NOW)
    assert sorted(r.link for r in index.known(names(spark, *"abcd"), before=3).collect()) == ["a", "b", "c"]
    assert sorted(r.link for r in index.known(names(spark, *"abcd"), before=1).collect()) == ["a"]


def test_batches_without_notices_leave_no_folder(spark, tmp_path):
    """What looks up the notices sent lists one folder a period, not one a batch."""
    batch = land_batch(spark, tmp_path, [(HOT, "l1", "", 0)])
    store = Store(spark, str(tmp_path / "store")).create()
    for n in range(2):
        run_cycle(batch, n, store, CycleSettings(clock=lambda n: NOW, daily_notice=True))
    assert [p.name for p in (tmp_path / "store" / "notices").iterdir()] == ["batch_id=0"]
    assert store.last_batch(5) == store.last_batch(2) == 1 and store.last_batch(0) == -1
