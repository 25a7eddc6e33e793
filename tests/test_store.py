import pytest
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from signalsieve import schemas
from signalsieve.operators import dedup as D
from signalsieve.operators import store as Q
from signalsieve.operators.numbering import number_rows
from signalsieve.plans import reports as P

NOW = datetime(2024, 1, 20, 12)


def items(spark, rows):
    """rows: dicts with any of the item columns."""
    base = dict(title="t", link=None, pub_date="", author="", category="", content="", full_content="",
                download_links=None, site_name="s", created_at=NOW)
    full = []
    for r in rows:
        r = {**base, **r}
        r["link"] = r["link"] or f"l{r['id']}"
        full.append(tuple(r[f.name] for f in schemas.ITEMS.fields))
    return spark.createDataFrame(full, schemas.ITEMS)


def analysis(spark, rows):
    base = dict(score=5, category="other", tags=[], summary="sum", affected_targets=[], estimated_records=-1,
                data_types=[], is_urgent=False, confidence_level="low", reasoning="", model_used="m", analyzed_at=NOW)
    return spark.createDataFrame(
        [tuple({**base, **r}[f.name] for f in schemas.ANALYSIS.fields) for r in rows], schemas.ANALYSIS)


def ids(df, col="id"):
    return [r[col] for r in df.collect()]


def test_dedup_and_insert(spark):
    batch = spark.createDataFrame(
        [(1, "a", 2, 0), (2, "a", 1, 5), (3, "b", 1, 1), (4, "b", 1, 0), (5, "c", 0, 0)],
        "id long, link string, source_rank int, position int")
    assert sorted(ids(D.dedup_links(batch))) == [2, 4, 5]
    stored = spark.createDataFrame([(9, "c", 0, 0)], batch.schema)
    assert sorted(ids(D.new_items(batch, stored))) == [1, 2, 3, 4]
    assert sorted(ids(D.new_items_of_small_batch(batch, stored))) == [1, 2, 3, 4]
    once = D.insert_ignore(stored, batch)
    assert sorted(ids(once)) == [2, 4, 9]
    assert sorted(ids(D.insert_ignore(once, batch))) == [2, 4, 9]


def test_wide_row_dedup_equals_dedup(spark):
    df = spark.range(5_000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 700).cast("string")).alias("link"),
        (F.col("id") % 5).alias("source_rank"), F.col("id").alias("position"), F.repeat(F.lit("x"), 500).alias("content"))
    want = sorted(ids(D.dedup_links(df)))
    assert sorted(ids(D.dedup_links_of_wide_rows(df))) == want


def test_hot_link_keeps_one_row(spark):
    hot = spark.range(20_000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("link"),
        F.lit(0).alias("source_rank"), F.col("id").alias("position"))
    out = D.dedup_links(hot)
    assert out.count() == 20_000 - 6_667 + 1
    assert ids(out.filter("link = 'hot'")) == [0]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_freshness_edges(spark):
    dates = ["", "yesterday", "2024-01-13T12:00:00Z", "2024-01-13T12:00:01Z", "2024-01-13T20:00:01+08:00",
             "2024-02-30T00:00:00Z", "2024-01-01", None, "2024-01-13T12:00:00,5Z"]
    df = spark.createDataFrame(list(enumerate(dates)), "id long, pub_date string")
    assert sorted(ids(D.fresh_items(df, 7, NOW))) == [0, 1, 3, 4, 5, 6, 7, 8]
    assert D.fresh_items(df, 0, NOW).count() == len(dates)


def test_list_items_inclusive(spark):
    df = items(spark, [dict(id=i, created_at=NOW + timedelta(hours=i)) for i in range(5)])
    got = Q.list_items(df, since=NOW + timedelta(hours=1), until=NOW + timedelta(hours=3), desc=True)
    assert ids(got) == [3, 2, 1]
    assert ids(Q.list_items(df, limit=2)) == [0, 1]
    assert Q.total_count(df, NOW, NOW).first().n == 1


def test_top_scored_ties_and_local_day(spark):
    df = items(spark, [dict(id=1, created_at=datetime(2024, 1, 4, 15, 59, 59)), dict(id=2, created_at=datetime(2024, 1, 4, 16)),
                       dict(id=3, created_at=datetime(2024, 1, 5, 15, 59, 59)), dict(id=4, created_at=datetime(2024, 1, 5, 16))])
    an = analysis(spark, [dict(item_id=i, score=7) for i in (4, 3, 2, 1)])
    assert ids(Q.top_scored_day(df, an, date(2024, 1, 5))) == [2, 3]
    assert ids(Q.top_scored_day(df, an, date(2024, 1, 5), n=1)) == [2]
    rows = Q.top_scored_per_day(df, an, 1).collect()
    assert sorted((str(r.day), r.id) for r in rows) == [("2024-01-04", 1), ("2024-01-05", 2), ("2024-01-06", 4)]


def test_upsert_is_idempotent(spark):
    old = analysis(spark, [dict(item_id=1, score=1), dict(item_id=2, score=2)])
    new = analysis(spark, [dict(item_id=2, score=8), dict(item_id=3, score=3),
                           dict(item_id=3, score=9, analyzed_at=NOW + timedelta(1))])
    once = Q.upsert_analysis(old, new)
    want = [(1, 1), (2, 8), (3, 9)]
    assert sorted((r.item_id, r.score) for r in once.collect()) == want
    assert sorted((r.item_id, r.score) for r in Q.upsert_analysis(once, new).collect()) == want


def test_urgent_and_notified(spark):
    df = items(spark, [dict(id=i) for i in (1, 2, 3)])
    an = analysis(spark, [dict(item_id=1, is_urgent=True), dict(item_id=2, is_urgent=True, analyzed_at=NOW + timedelta(1)),
                          dict(item_id=3)])
    done = spark.createDataFrame([], schemas.NOTIFIED)
    first = Q.urgent_unnotified(df, an, done)
    assert ids(first) == [2, 1]
    done = Q.mark_notified(done, first.select(F.col("id").alias("item_id")).filter("item_id = 2"))
    assert ids(Q.urgent_unnotified(df, an, done)) == [1]


def test_prune_cascades(spark):
    df = items(spark, [dict(id=1, created_at=NOW - timedelta(days=10)), dict(id=2, created_at=NOW - timedelta(days=10, seconds=1))])
    an = analysis(spark, [dict(item_id=1), dict(item_id=2), dict(item_id=77)])
    out = Q.prune(df, an, 10, NOW)
    assert ids(out.items) == [1] and sorted(ids(out.analysis, "item_id")) == [1, 77] and out.deleted.first().deleted == 1
    assert Q.prune(df, an, 0, NOW).items.count() == 2


def test_pages_concatenate_to_everything(spark):
    df = items(spark, [dict(id=i, created_at=NOW + timedelta(seconds=i // 4)) for i in range(23)])
    an = analysis(spark, [dict(item_id=3, score=9)])
    seen, cursor = [], None
    while True:
        page = Q.page_items(df, an, cursor=cursor, limit=5).orderBy("page_row").collect()
        seen += [r.id for r in page]
        if not page[0].has_more:
            assert page[0].next_id is None
            break
        cursor = Q.Cursor(page[0].next_created_at, page[0].next_id)
    assert seen == list(range(22, -1, -1))
    with pytest.raises(ValueError):
        Q.page_items(df, an, limit=500)
    row = Q.page_items(df, an).filter("id = 3").first()
    assert row.ai_score == 9 and row.ai_summary == "sum"


def test_stats_and_calendar(spark):
    df = items(spark, [dict(id=1, site_name="a", created_at=datetime(2024, 1, 19, 16)),
                       dict(id=2, site_name="b", created_at=datetime(2024, 1, 19, 15, 59, 59)),
                       dict(id=3, site_name="b", created_at=datetime(2024, 1, 10))])
    got = {(r.scope, r.site_name): (r.total_count, r.today_count) for r in Q.stats(df, NOW).collect()}
    assert got == {("all", ""): (3, 1), ("source", "a"): (1, 1), ("source", "b"): (2, 0)}
    days = [(r.label, r.n) for r in Q.last_7_days(df, NOW).orderBy("day").collect()]
    assert days == [("01/14", 0), ("01/15", 0), ("01/16", 0), ("01/17", 0), ("01/18", 0), ("01/19", 1), ("01/20", 1)]
    share = [r.share for r in P.activity_share(df.limit(0), NOW).collect()]
    assert share == [0.0] * 7


def test_export_window_and_json(spark, tmp_path):
    since, until = Q.export_window(date(2024, 1, 5), date(2024, 1, 6), NOW)
    assert (since, until) == (datetime(2024, 1, 5), datetime(2024, 1, 6, 23, 59, 59))
    assert Q.export_window(None, None, NOW) == (NOW - timedelta(days=30), NOW)
    df = items(spark, [dict(id=1, full_content="page"), dict(id=2)])
    out = Q.export_training(df, analysis(spark, [dict(item_id=1), dict(item_id=2, score=9)]), NOW, NOW)
    assert ids(out, "item_id") == [2, 1] and len(out.columns) == 18
    Q.write_export(out.coalesce(1), str(tmp_path / "x"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "x")).collect()]
    assert ['"full_content"' in x for x in lines] == [False, True]


def test_number_rows_is_global(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k"))
    rows = number_rows(df, [F.col("k").desc()]).collect()
    assert sorted((r.row_number, r.k) for r in rows) == [(i + 1, 4999 - i) for i in range(5000)]


def test_missing_columns_are_added(spark):
    df = spark.createDataFrame([(1, "t")], "id long, title string")
    row = schemas.conform(df, schemas.ITEMS).first()
    assert row.full_content == "" and row.link is None


def test_report_files_round_trip(spark, tmp_path):
    df = items(spark, [dict(id=i, title=f"[s{i % 2}] t{i}", site_name=f"s{i % 2}",
                            created_at=datetime(2024, 1, 7, 15, 30) + timedelta(hours=i)) for i in range(6)])
    folder = str(tmp_path / "md")
    P.write_blocks(P.report_markdown(df, P.DAILY, NOW), folder)
    for period, n in (("2024-01-07", 1), ("2024-01-08", 5)):
        files = sorted((tmp_path / "md" / f"period={period}").glob("part-*"))
        text = "".join(f.read_text() for f in files)
        assert text.startswith(f"# Daily leak report {period}\n\n**{n}** items collected\n\nLast updated: 2024-01-20 12:00:00\n")
        assert text.count("\n### [") == n and text.endswith("\n---\n\nGenerated by signalsieve\n")
        stamps = [line for line in text.splitlines() if line.startswith("- **Found at**")]
        assert stamps == sorted(stamps, reverse=True)
        assert sum(int(x.split(": ")[1]) for x in text.splitlines() if x.startswith("- s")) == n
    weeks = {r.period: r.n for r in P.weekly_report(df).totals.collect()}
    assert weeks == {"2024-01-01_2024-01-07": 1, "2024-01-08_2024-01-14": 5}


def test_rss_parses(spark, tmp_path):
    import xml.etree.ElementTree as ET

    df = items(spark, [dict(id=1, title="a <b> & c", content="x > y", full_content=""), dict(id=2, full_content="page")])
    P.write_rss(P.report_rss(df, P.DAILY, "https://example.org", NOW), str(tmp_path / "rss"), "daily")
    for name in ("daily_rss", "latest_daily_rss"):
        text = "".join(f.read_text() for f in sorted((tmp_path / "rss" / name).glob("period=*/part-*")))
        channel = ET.fromstring(text).find("channel")
        assert [(i.findtext("title"), i.findtext("description")) for i in channel.findall("item")] == [
            ("t", "page"), ("a <b> & c", "x > y")]
        assert channel.findall("item")[0].findtext("guid") == "l2_20240120120000"
