import json
from datetime import datetime

from pyspark.sql import functions as F

from signalsieve.functions.periods import utc_literal
from signalsieve.operators import alerts as N

AT = datetime(2024, 1, 2, 3, 4, 5)


def alert(spark, **kw):
    base = dict(item_id=1, title="T_1", body="B", link="https://x/(1)", site_name="s", kind="normal", score=9, category="other",
                summary="S.", affected_targets=["A", "B"], data_types=["email"], estimated_records=1234567, is_urgent=True,
                confidence_level="high")
    row = {**base, **kw}
    return spark.createDataFrame(
        [tuple(row[n] for n in N.ALERT_FIELDS)],
        "item_id long, title string, body string, link string, site_name string, kind string, score int, category string, "
        "summary string, affected_targets array<string>, data_types array<string>, estimated_records int, is_urgent boolean, "
        "confidence_level string")


def one(df, col):
    return df.select(col.alias("x")).first().x


def test_rich_text(spark):
    assert one(alert(spark), N.render_rich()) == (
        "🔴 *\\[9/10\\]* `other` ⚠️ *URGENT*\n" + "━" * 20 + "\n📄 *T\\_1*\n📌 Source: `s`\n🎯 Targets: A, B\n📦 Types: email\n"
        "📊 Size: ≈1,234,567 records\n🤖 S\\.\n🔗 [Open post](https://x/(1\\))")
    bare = alert(spark, link="", summary="", affected_targets=[], data_types=[], estimated_records=-1, is_urgent=False, score=4)
    assert one(bare, N.render_rich()) == "🔵 *\\[4/10\\]* `other`\n" + "━" * 20 + "\n📄 *T\\_1*\n📌 Source: `s`\n"


def test_plain_layouts(spark):
    df = alert(spark, score=0)
    assert one(df, N.render_plain("markdown")) == "**T_1**\nB\nLink: https://x/(1)"
    assert one(df, N.render_plain("text")) == "T_1\nB\nLink: https://x/(1)"
    assert one(df, N.render_plain("rich")) == "*T\\_1*\nB\n[Link](https://x/(1\\))"
    assert one(alert(spark, link=None), N.render_plain("text")) == "T_1\nB"


def test_embeds_by_kind(spark):
    def embed(kind):
        [e] = json.loads(one(alert(spark, kind=kind), N.render_embed(utc_literal(AT))))["embeds"]
        return e

    urgent = embed("urgent")
    assert urgent["color"] == 0xED4245 and urgent["description"] == "B" and urgent["timestamp"] == "2024-01-02T03:04:05Z"
    assert [f["inline"] for f in urgent["fields"]] == [True, True, False]
    assert "description" not in embed("normal") and len(embed("normal")["fields"]) == 3
    assert embed("daily")["fields"] == [{"name": "Summary of the day", "value": "B", "inline": False}]
    assert "fields" not in embed("startup") and embed("startup")["color"] == 0x57F287


def test_routing(spark):
    quiet = N.Channel("e", "embed", send_normal=False, send_daily=False, send_weekly=False)
    channels = [quiet, N.Channel("t", "text", send_normal=False), N.Channel("off", "text", enabled=False)]
    for kind, want in (("normal", ["t"]), ("daily", ["t"]), ("weekly", ["t"]), ("urgent", ["e", "t"]), ("startup", ["e", "t"])):
        assert sorted(r.channel for r in N.route_channels(alert(spark, kind=kind), channels).collect()) == want
    assert N.route_channels(alert(spark), []).count() == 0
    out = N.render_outbox(N.route_channels(alert(spark, kind="urgent"), channels), utc_literal(AT))
    assert {r.channel: r.payload[:4] for r in out.collect()} == {"e": '{"em', "t": "T_1\n"}


def test_selection_threshold(spark):
    rows = alert(spark, score=5).drop("body", "kind", "item_id").withColumn("id", F.lit(1))
    assert N.select_alerts(rows, category_col="category").count() == 1
    assert N.select_alerts(rows, 6, "category").count() == 0
    assert N.select_alerts(rows, 0, "category").first().kind == "urgent"


def test_plain_item_alerts(spark):
    items = spark.createDataFrame([(1, "T", "l", "s")], "id long, title string, link string, site_name string")
    row = N.plain_item_alerts(items).first()
    assert (row.title, row.body, row.score, row.kind) == ("s new leak item", "T", 0, "normal")


def test_weekly_notice(spark):
    totals = spark.createDataFrame([("2024-01-01_2024-01-07", 3)], "period string, n long")
    row = N.report_notice(totals, N.WEEKLY).first()
    assert row.title == "Weekly leak report 2024-01-01_2024-01-07" and row.body == "3 leak items collected"
