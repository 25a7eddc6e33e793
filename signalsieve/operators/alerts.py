"""Alerts as outbox rows: selection, fan-out to channels, and message texts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalsieve.functions import fixed_values as fv
from signalsieve.functions.phrases import ENGLISH, Phrases, fill
from signalsieve.functions.reuse import reuse
from signalsieve.functions.text import comma_number, escape_markup, escape_url, score_badge, text_or_empty
from signalsieve.operators.store import urgent_unnotified

NORMAL, STARTUP, DAILY, WEEKLY, URGENT = "normal", "startup", "daily", "weekly", "urgent"
RULE = "━" * 20

ALERT_FIELDS = (
    "item_id", "title", "body", "link", "site_name", "kind", "score", "category", "summary",
    "affected_targets", "data_types", "estimated_records", "is_urgent", "confidence_level",
)


@dataclass(frozen=True)
class Channel:
    """One delivery channel. ``layout`` is rich, markdown, text or embed; only the
    ``send_*`` flags of an embed channel can hold messages back."""

    name: str
    layout: str
    enabled: bool = True
    send_normal: bool = True
    send_daily: bool = True
    send_weekly: bool = True


def _alert(title: Column, category: Column, urgent: Column, kind: Column) -> list[Column]:
    values = {
        "item_id": F.col("id"), "title": title, "body": F.col("summary"), "kind": kind,
        "category": category, "is_urgent": urgent,
    }
    return [values.get(n, F.col(n)).alias(n) for n in ALERT_FIELDS]


def select_alerts(scored: DataFrame, min_score: int = 0, category_col: str = "ai_category") -> DataFrame:
    """Rows worth a message. Urgent rows count as notified from here on
    (``notified_ids``)."""
    floor = min_score if min_score > 0 else fv.DEFAULT_NOTIFY_MIN_SCORE
    urgent = F.col("is_urgent")
    kind = F.when(urgent, URGENT).otherwise(NORMAL)
    return scored.filter(F.col("score") >= floor).select(
        *_alert(F.col("title"), F.col(category_col), urgent, kind)
    )


def notified_ids(alerts: DataFrame) -> DataFrame:
    """Item ids that the given alerts mark as notified."""
    return alerts.filter(F.col("kind") == URGENT).select("item_id").distinct()


def pending_urgent_outbox(items: DataFrame, analysis: DataFrame, notified: DataFrame) -> DataFrame:
    """Urgent items missed so far, as urgent alerts with the site in front."""
    title = F.concat(F.lit("["), F.col("site_name"), F.lit("] "), F.col("title"))
    return urgent_unnotified(items, analysis, notified).select(
        *_alert(title, F.col("ai_category"), F.lit(True), F.lit(URGENT))
    )


def plain_item_alerts(items: DataFrame, title_suffix: str = " new leak item") -> DataFrame:
    """N1 without any scorer: every fresh item becomes a plain message."""
    empty = F.array().cast("array<string>")
    return items.select(
        F.col("id").alias("item_id"),
        F.concat(F.col("site_name"), F.lit(title_suffix)).alias("title"),
        F.col("title").alias("body"),
        "link",
        "site_name",
        F.lit(NORMAL).alias("kind"),
        F.lit(0).alias("score"),
        F.lit("").alias("category"),
        F.lit("").alias("summary"),
        empty.alias("affected_targets"),
        empty.alias("data_types"),
        F.lit(0).alias("estimated_records"),
        F.lit(False).alias("is_urgent"),
        F.lit("").alias("confidence_level"),
    )


def route_channels(alerts: DataFrame, channels: Sequence[Channel]) -> DataFrame:
    """One row per alert and channel that takes it. Channels are configuration, so the
    fan-out is an explode of a literal array: no join, no shuffle."""
    live = [c for c in channels if c.enabled]
    kind = F.col("kind")
    entries = []
    for ch in live:
        entry = F.struct(F.lit(ch.name).alias("channel"), F.lit(ch.layout).alias("layout"))
        muted = [
            k for k, on in ((NORMAL, ch.send_normal), (DAILY, ch.send_daily), (WEEKLY, ch.send_weekly))
            if ch.layout == "embed" and not on
        ]
        entries.append(F.when(~kind.isin(muted), entry) if muted else entry)
    none = F.array().cast("array<struct<channel:string,layout:string>>")
    fan = F.array_compact(F.array(*entries)) if entries else none
    return alerts.withColumn("_to", F.explode(fan)).select(
        *alerts.columns, F.col("_to.channel").alias("channel"), F.col("_to.layout").alias("layout")
    )


def render_rich(phrases: Phrases = ENGLISH) -> Column:
    """Rich text of a scored alert; absent parts leave no line."""
    c = F.col
    head = F.concat(
        score_badge(c("score")),
        F.lit(" *\\["), c("score").cast("string"), F.lit("/10\\]* `"),
        escape_markup(c("category")),
        F.when(c("is_urgent"), "` ⚠️ *URGENT*").otherwise("`"),
    )

    def line(template: str, value: Column, shown: Column) -> Column:
        return F.when(shown, fill(template, v=value))

    lines = [
        head,
        F.lit(RULE),
        F.concat(F.lit("📄 *"), escape_markup(c("title")), F.lit("*")),
        fill(phrases.rich_site, v=escape_markup(c("site_name"))),
        line(phrases.rich_targets, escape_markup(F.array_join("affected_targets", ", ")),
             F.size("affected_targets") > 0),
        line(phrases.rich_types, escape_markup(F.array_join("data_types", " · ")), F.size("data_types") > 0),
        line(phrases.rich_records, escape_markup(comma_number(c("estimated_records"))),
             c("estimated_records") > 0),
        line("🤖 {v}", escape_markup(c("summary")), text_or_empty(c("summary")) != ""),
        # the link line comes last and has no line break after it
        F.when(text_or_empty(c("link")) != "", fill(phrases.rich_link, v=escape_url(c("link")))).otherwise(""),
    ]
    return F.concat_ws("\n", *lines)


def render_plain(layout: str, phrases: Phrases = ENGLISH) -> Column:
    """The plain layouts; ``rich`` switches to N4 for scored alerts."""
    c = F.col
    has_link = text_or_empty(c("link")) != ""
    link_line = F.when(has_link, F.concat(F.lit("\n" + phrases.plain_link), c("link"))).otherwise("")
    body = text_or_empty(c("body"))
    if layout == "markdown":
        return F.concat(F.lit("**"), c("title"), F.lit("**\n"), body, link_line)
    if layout == "text":
        return F.concat(c("title"), F.lit("\n"), body, link_line)
    if layout == "rich":
        target = F.when(
            has_link,
            F.concat(F.lit(f"\n[{phrases.link_text}]("), escape_url(c("link")), F.lit(")")),
        ).otherwise("")
        plain = F.concat(F.lit("*"), escape_markup(c("title")), F.lit("*\n"), escape_markup(body), target)
        return F.when(c("score") > 0, render_rich(phrases)).otherwise(plain)
    raise ValueError(f"no plain layout {layout!r}")


def render_embed(sent_at: Column, phrases: Phrases = ENGLISH, normal_color: int = fv.COLOR_REPORT) -> Column:
    """Structured payload as JSON; the shape depends on the kind."""
    c = F.col

    def field(name: str, value: Column, inline: bool) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(inline).alias("inline"))

    sent_text = F.date_format(sent_at, "yyyy-MM-dd HH:mm:ss")
    link = F.when(
        text_or_empty(c("link")) != "",
        field(phrases.embed_link, F.concat(F.lit(f"[{phrases.embed_open}]("), c("link"), F.lit(")")), False),
    )
    of_item = F.array_compact(
        F.array(field(phrases.embed_site, c("site_name"), True), field(phrases.embed_time, sent_text, True), link)
    )
    kind = c("kind")

    def by_kind(startup, urgent, weekly, daily, normal) -> Column:
        return (
            F.when(kind == STARTUP, startup).when(kind == URGENT, urgent).when(kind == WEEKLY, weekly)
            .when(kind == DAILY, daily).otherwise(normal)
        )

    embed = F.struct(
        F.nullif(c("title"), F.lit("")).alias("title"),
        F.when(kind.isin(STARTUP, URGENT), F.nullif(c("body"), F.lit(""))).alias("description"),
        by_kind(fv.COLOR_STARTUP, fv.COLOR_URGENT, fv.COLOR_REPORT, fv.COLOR_REPORT, normal_color).alias("color"),
        by_kind(
            None,
            of_item,
            F.array(field(phrases.embed_weekly, c("body"), False)),
            F.array(field(phrases.embed_daily, c("body"), False)),
            of_item,
        ).alias("fields"),
        F.struct(
            by_kind(*[phrases.embed_footers[k] for k in (STARTUP, URGENT, WEEKLY, DAILY, NORMAL)]).alias("text")
        ).alias("footer"),
        F.date_format(sent_at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
    )
    return F.to_json(F.struct(F.array(embed).alias("embeds")))


def render_outbox(routed: DataFrame, sent_at: Column, phrases: Phrases = ENGLISH) -> DataFrame:
    """Outbox rows: each routed alert with the text of its channel's layout."""
    payload = reuse("outbox payload", (phrases,), lambda: _payload(F.col("_sent_at"), phrases))
    return routed.withColumn("_sent_at", sent_at).withColumn("payload", payload).drop("_sent_at")


def _payload(sent_at: Column, phrases: Phrases) -> Column:
    layout = F.col("layout")
    return (
        F.when(layout == "rich", render_plain("rich", phrases))
        .when(layout == "markdown", render_plain("markdown", phrases))
        .when(layout == "embed", render_embed(sent_at, phrases))
        .otherwise(render_plain("text", phrases))
    )


def report_notice(
    totals: DataFrame, kind: str, digest: DataFrame | None = None, phrases: Phrases = ENGLISH
) -> DataFrame:
    """Message of a finished report. ``totals`` holds (period, n); ``digest`` holds
    (period, digest) texts of the daily top list."""
    title = phrases.daily_title if kind == DAILY else phrases.weekly_title
    out = totals.withColumn("body", fill(phrases.notice_total, n=F.col("n")))
    if kind == DAILY and digest is not None:
        out = out.join(digest, "period", "left").withColumn(
            "body", F.concat("body", text_or_empty(F.col("digest")))
        )
    return out.select(
        "period",
        fill(title, period=F.col("period")).alias("title"),
        "body",
        F.lit(kind).alias("kind"),
    )


def notice_alerts(notices: DataFrame) -> DataFrame:
    """Rows of ``report_notice`` in the shape of alerts, to be routed and rendered like them."""
    none = F.lit("")
    values = {
        "item_id": F.lit(None).cast("long"), "link": none, "site_name": none, "score": F.lit(0), "category": none,
        "summary": none, "affected_targets": F.array().cast("array<string>"),
        "data_types": F.array().cast("array<string>"), "estimated_records": F.lit(0), "is_urgent": F.lit(False),
        "confidence_level": none,
    }
    return notices.select("period", *[values.get(n, F.col(n)).alias(n) for n in ALERT_FIELDS])
