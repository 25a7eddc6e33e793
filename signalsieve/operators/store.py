"""The stored queries over the item and analysis tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalsieve.functions import fixed_values as fv
from signalsieve.functions.periods import day_bounds, in_range, local_day, local_today, utc_literal
from signalsieve.functions.text import preview, text_or_empty
from signalsieve.operators.scoring import RESULT_FIELDS

# Text form of stored timestamps.
DATETIME_TEXT = "yyyy-MM-dd HH:mm:ss"


def datetime_text(ts: Column) -> Column:
    return F.date_format(ts, DATETIME_TEXT)


def created_between(since: datetime | None, until: datetime | None) -> Column:
    """Inclusive bounds on the raw column; they reach the Parquet scan."""
    cond = F.lit(True)
    if since is not None:
        cond = cond & (F.col("created_at") >= utc_literal(since))
    if until is not None:
        cond = cond & (F.col("created_at") <= utc_literal(until))
    return cond


def list_items(
    items: DataFrame,
    site: str = "",
    since: datetime | None = None,
    until: datetime | None = None,
    desc: bool = False,
    limit: int = 0,
) -> DataFrame:
    """Q1: optional predicates, order by creation time (then id)."""
    out = items.filter(created_between(since, until))
    if site:
        out = out.filter(F.col("site_name") == site)
    keys = ["created_at", "id"]
    out = out.orderBy(*[F.col(k).desc() if desc else F.col(k).asc() for k in keys])
    return out.limit(limit) if limit > 0 else out


def count_by_source(items: DataFrame, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Q2, and Q4 without bounds: items per source, most first, then by name."""
    return (
        items.filter(created_between(since, until))
        .groupBy("site_name")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col("site_name"))
    )


def total_count(items: DataFrame, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Q3: number of items in the range."""
    return items.filter(created_between(since, until)).agg(F.count(F.lit(1)).alias("n"))


def with_analysis(items: DataFrame, analysis: DataFrame, how: str = "inner") -> DataFrame:
    """Items next to their analysis; item and analysis category get separate names."""
    right = analysis.select(
        "item_id",
        *[F.col(n).alias("ai_category" if n == "category" else n) for n in RESULT_FIELDS],
        "model_used",
        "analyzed_at",
    )
    return items.join(right, items["id"] == right["item_id"], how)


def top_scored_day(
    items: DataFrame, analysis: DataFrame, day: date, n: int = fv.DEFAULT_DAILY_TOP_N,
    tz_offset_hours: int = fv.DEFAULT_TZ_OFFSET_HOURS,
) -> DataFrame:
    """Q5: best scored items created on a local day; ties by id."""
    of_day = items.filter(in_range(F.col("created_at"), day_bounds(day, tz_offset_hours)))
    return with_analysis(of_day, analysis).orderBy(F.col("score").desc(), F.col("id")).limit(n)


def top_scored_per_day(
    items: DataFrame, analysis: DataFrame, n: int = fv.DEFAULT_DAILY_TOP_N,
    tz_offset_hours: int = fv.DEFAULT_TZ_OFFSET_HOURS,
) -> DataFrame:
    """Q5 for every day at once. Each task drops all but its best ``n`` rows of a day
    before the shuffle, so a huge day stays small."""
    ranked = with_analysis(items, analysis).withColumn("day", local_day(F.col("created_at"), tz_offset_hours))
    order = Window.partitionBy("day").orderBy(F.col("score").desc(), F.col("id"))
    return ranked.withColumn("day_rank", F.row_number().over(order)).filter(F.col("day_rank") <= n)


def urgent_unnotified(items: DataFrame, analysis: DataFrame, notified: DataFrame) -> DataFrame:
    """Q6: urgent items nobody was told about, last analysed first."""
    urgent = analysis.filter("is_urgent").join(notified.select("item_id"), "item_id", "left_anti")
    return with_analysis(items, urgent).orderBy(F.col("analyzed_at").desc(), F.col("id"))


def mark_notified(notified: DataFrame, ids: DataFrame) -> DataFrame:
    """Q7: the key table of notified items with the given ids added."""
    return notified.select("item_id").union(ids.select("item_id")).distinct()


def export_window(since: date | None, until: date | None, now: datetime) -> tuple[datetime, datetime]:
    """Bounds of an export: the last 30 days by default, the end date inclusive."""
    start = datetime(since.year, since.month, since.day) if since else now - timedelta(days=30)
    end = datetime(until.year, until.month, until.day, 23, 59, 59) if until else now
    return start, end


def export_training(items: DataFrame, analysis: DataFrame, since: datetime, until: datetime) -> DataFrame:
    """Q8: flat 18-column records, best score first; an empty full page is null, so that
    a JSON writer leaves it out."""
    return (
        with_analysis(items.filter(created_between(since, until)), analysis)
        .select(
            F.col("id").alias("item_id"),
            "title",
            "content",
            F.nullif(F.col("full_content"), F.lit("")).alias("full_content"),
            "site_name",
            "score",
            F.col("ai_category").alias("category"),
            "tags",
            "summary",
            "affected_targets",
            "estimated_records",
            "data_types",
            "is_urgent",
            "confidence_level",
            "reasoning",
            "model_used",
            datetime_text(F.col("created_at")).alias("created_at"),
            datetime_text(F.col("analyzed_at")).alias("analyzed_at"),
        )
        .orderBy(F.col("score").desc(), F.col("item_id"))
    )


def write_export(records: DataFrame, folder: str) -> None:
    """Q8 as line-delimited JSON, in order over the part files; nulls are left out."""
    records.write.mode("overwrite").option("ignoreNullFields", True).json(folder)


def newest_analysis(rows: DataFrame) -> DataFrame:
    """One row per item, the last analysed."""
    order = Window.partitionBy("item_id").orderBy(
        F.col("analyzed_at").desc(), F.col("model_used"), F.col("score").desc()
    )
    return rows.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def upsert_analysis(old: DataFrame, new: DataFrame) -> DataFrame:
    """Q9: new rows replace old ones of the same item. The old table is filtered, never
    sorted; with a small batch the runtime broadcasts its ids."""
    latest = newest_analysis(new)
    kept = old.join(latest.select("item_id"), "item_id", "left_anti")
    return kept.unionByName(latest)


def denormalize(items: DataFrame, analysis: DataFrame) -> DataFrame:
    """Q10: score, category and urgency next to every item, with defaults."""
    right = analysis.select(
        F.col("item_id").alias("id"),
        F.col("score").alias("ai_score"),
        F.col("category").alias("ai_category"),
        F.col("is_urgent").alias("ai_urgent"),
    )
    return items.join(right, "id", "left").withColumns(
        {
            "ai_score": F.coalesce("ai_score", F.lit(0)),
            "ai_category": F.coalesce("ai_category", F.lit("")),
            "ai_urgent": F.coalesce("ai_urgent", F.lit(False)),
        }
    )


def get_analysis(ids: DataFrame, analysis: DataFrame) -> DataFrame:
    """Q11: the analysis of each id, nulls where there is none."""
    return ids.select("item_id").join(analysis, "item_id", "left")


@dataclass(frozen=True)
class Pruned:
    items: DataFrame
    analysis: DataFrame
    deleted: DataFrame


def prune(items: DataFrame, analysis: DataFrame, retention_days: int, now: datetime) -> Pruned:
    """Q12: items older than the retention go, their analysis with them."""
    if retention_days <= 0:
        none = items.limit(0).agg(F.count(F.lit(1)).alias("deleted"))
        return Pruned(items, analysis, none)
    expired = F.col("created_at") < utc_literal(now.replace(microsecond=0) - timedelta(days=retention_days))
    gone = items.filter(expired).select(F.col("id").alias("item_id"))
    return Pruned(
        items.filter(~expired),
        analysis.join(gone, "item_id", "left_anti"),
        gone.agg(F.count(F.lit(1)).alias("deleted")),
    )


@dataclass(frozen=True)
class Cursor:
    """Place of the last row of a page."""

    created_at: datetime
    id: int


def page_items(
    items: DataFrame,
    analysis: DataFrame,
    site: str = "",
    cursor: Cursor | None = None,
    limit: int = fv.PAGE_DEFAULT_LIMIT,
) -> DataFrame:
    """Q13: one page, newest first, with the scoring result and where to go on.

    ``next_created_at``/``next_id`` are set on every row while there is another page.
    """
    if not 0 < limit <= fv.PAGE_MAX_LIMIT:
        raise ValueError(f"a page has 1 to {fv.PAGE_MAX_LIMIT} rows, not {limit}")
    size = limit
    rows = items.filter(F.col("site_name") == site) if site else items
    if cursor is not None:
        at = utc_literal(cursor.created_at)
        rows = rows.filter(
            (F.col("created_at") <= at)
            & ((F.col("created_at") < at) | (F.col("id") < cursor.id))
        )
    newest = [F.col("created_at").desc(), F.col("id").desc()]
    page = rows.orderBy(*newest).limit(size + 1)
    # everything below sees at most size + 1 rows
    whole = Window.orderBy(*newest)
    page = (
        page.withColumn("page_row", F.row_number().over(whole))
        .withColumn("_seen", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
        .withColumn("has_more", F.col("_seen") > size)
    )
    page = page.withColumns(
        {
            f"next_{k}": F.max(F.when(F.col("has_more") & (F.col("page_row") == size), F.col(k))).over(
                Window.partitionBy(F.lit(1))
            )
            for k in ("created_at", "id")
        }
    ).filter(F.col("page_row") <= size)
    hits = analysis.join(
        F.broadcast(page.select(F.col("id").alias("item_id"))), "item_id", "left_semi"
    ).select(
        F.col("item_id").alias("id"),
        F.col("score").alias("ai_score"),
        F.col("category").alias("ai_category"),
        F.col("is_urgent").alias("ai_urgent"),
        F.col("summary").alias("ai_summary"),
    )
    return page.join(F.broadcast(hits), "id", "left").select(
        "page_row", "id", "title", "link", "pub_date", "author", "category",
        preview(F.col("content"), fv.PAGE_PREVIEW_CHARS).alias("content"),
        *(["download_links"] if "download_links" in page.columns else []),
        "site_name", "created_at",
        F.coalesce("ai_score", F.lit(0)).alias("ai_score"),
        F.coalesce("ai_category", F.lit("")).alias("ai_category"),
        F.coalesce("ai_urgent", F.lit(False)).alias("ai_urgent"),
        F.coalesce("ai_summary", F.lit("")).alias("ai_summary"),
        "has_more", "next_created_at", "next_id",
    )


def stats(items: DataFrame, now: datetime, tz_offset_hours: int = fv.DEFAULT_TZ_OFFSET_HOURS) -> DataFrame:
    """Q14: totals and today's count per source and overall (scope ``all``, there even without items).

    The overall row adds up the rows of the sources.
    """
    today = in_range(F.col("created_at"), day_bounds(local_today(now, tz_offset_hours), tz_offset_hours))
    by_source = items.select("site_name", today.alias("_today")).groupBy("site_name").agg(
        F.count(F.lit(1)).alias("total_count"), F.count_if(F.col("_today")).alias("today_count"))
    zero = F.lit(0).cast("long")
    overall = by_source.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("total_count", "today_count")])
    return by_source.select(
        F.lit("source").alias("scope"), text_or_empty(F.col("site_name")).alias("site_name"), "total_count", "today_count"
    ).unionByName(overall.select(F.lit("all").alias("scope"), F.lit("").alias("site_name"), "total_count", "today_count"))


def last_7_days(
    items: DataFrame, now: datetime, tz_offset_hours: int = fv.DEFAULT_TZ_OFFSET_HOURS
) -> DataFrame:
    """Q15: seven local days up to today, days without items as zero."""
    today = local_today(now, tz_offset_hours)
    span = (day_bounds(today - timedelta(days=6), tz_offset_hours)[0], day_bounds(today, tz_offset_hours)[1])
    counts = (
        items.filter(in_range(F.col("created_at"), span))
        .groupBy(local_day(F.col("created_at"), tz_offset_hours).alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    first = F.lit(today - timedelta(days=6))
    days = items.sparkSession.range(7).select(F.date_add(first, F.col("id").cast("int")).alias("day"))
    return days.join(counts, "day", "left").select(
        "day",
        F.date_format("day", "MM/dd").alias("label"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
    )


def search_items(rows: DataFrame, q: str = "", site: str = "", min_score: int = 0) -> DataFrame:
    """Q16: substring search over title, site, category and summary of denormalised rows."""
    out = rows
    if site:
        out = out.filter(F.col("site_name") == site)
    if min_score > 0:
        out = out.filter(F.coalesce("ai_score", F.lit(0)) >= min_score)
    if q:
        hay = F.lower(
            F.concat(*[text_or_empty(F.col(n)) for n in ("title", "site_name", "ai_category", "ai_summary")])
        )
        out = out.filter(hay.contains(q.lower()))
    return out


def source_facets(items: DataFrame, by: str = "count") -> DataFrame:
    """Q17: items per source, by count or by name."""
    counts = items.groupBy("site_name").agg(F.count(F.lit(1)).alias("n"))
    if by == "name":
        return counts.orderBy("site_name")
    return counts.orderBy(F.col("n").desc(), F.col("site_name"))
