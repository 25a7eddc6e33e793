"""Reports and feeds over calendar periods, as datasets and as files."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalsieve.functions import fixed_values as fv
from signalsieve.functions.periods import day_bounds, in_range, local_day, local_week, utc_literal, week_bounds
from signalsieve.functions.phrases import ENGLISH, Phrases, fill
from signalsieve.functions.text import effective_body, preview, site_badge, text_or_empty
from signalsieve.operators.numbering import number_rows
from signalsieve.operators.store import datetime_text, last_7_days, top_scored_day
from signalsieve.plans.files import write_period_files
from signalsieve.plans.paged import ROWS_PER_FILE, read_numbered, read_page, write_paged

DAILY, WEEKLY, ALLTIME = "daily", "weekly", "alltime"


def period_of(kind: str, created_at: Column, tz_offset_hours: int = fv.DEFAULT_TZ_OFFSET_HOURS) -> Column:
    """Label of the period a row belongs to: the local day, the local Monday-to-Sunday
    week as ``start_end``, or ``all``."""
    if kind == DAILY:
        return local_day(created_at, tz_offset_hours).cast("string")
    if kind == WEEKLY:
        monday = local_week(created_at, tz_offset_hours)
        return F.concat(monday.cast("string"), F.lit("_"), F.date_add(monday, 6).cast("string"))
    return F.lit("all")


@dataclass(frozen=True)
class Report:
    """Items newest first, counts per source, and the total, per period."""

    items: DataFrame
    by_source: DataFrame
    totals: DataFrame


def report(items: DataFrame, kind: str, tz_offset_hours: int = fv.DEFAULT_TZ_OFFSET_HOURS,
           day: date | None = None, ordered: bool = True) -> Report:
    """P1 to P3. With ``day`` only the period that holds it, else every period at once.
    ``ordered=False`` saves the global sort for callers that order the rows themselves."""
    if day is not None and kind != ALLTIME:
        bounds = (day_bounds if kind == DAILY else week_bounds)(day, tz_offset_hours)
        items = items.filter(in_range(F.col("created_at"), bounds))
    dated = items.withColumn("period", period_of(kind, F.col("created_at"), tz_offset_hours))
    by_source = dated.groupBy("period", "site_name").agg(F.count(F.lit(1)).alias("n"))
    totals = by_source.groupBy("period").agg(F.sum("n").alias("n"))
    if ordered:
        dated = dated.orderBy("period", F.col("created_at").desc(), F.col("id").desc())
        by_source = by_source.orderBy("period", F.col("n").desc(), "site_name")
    return Report(dated, by_source, totals)


def daily_report(items: DataFrame, day: date | None = None, tz_offset_hours: int = fv.DEFAULT_TZ_OFFSET_HOURS) -> Report:
    return report(items, DAILY, tz_offset_hours, day)


def weekly_report(items: DataFrame, day: date | None = None, tz_offset_hours: int = fv.DEFAULT_TZ_OFFSET_HOURS) -> Report:
    return report(items, WEEKLY, tz_offset_hours, day)


def alltime_report(items: DataFrame) -> Report:
    return report(items, ALLTIME)


# order of the sections of a report file
HEAD, SOURCES, DETAIL_HEAD, DETAIL, FOOT = range(5)
BLOCK_ORDER = ["period", "section", "neg_n", "site_name", "neg_second", "neg_id"]


def _block(df: DataFrame, section: int, block: Column, **keys: Column) -> DataFrame:
    defaults = {"neg_n": F.lit(0).cast("long"), "site_name": F.lit(""), "neg_second": F.lit(0).cast("long"),
                "neg_id": F.lit(0).cast("long")}
    return df.select(
        "period",
        F.lit(section).alias("section"),
        *[keys.get(k, d).alias(k) for k, d in defaults.items()],
        block.alias("block"),
    )


def report_markdown(
    items: DataFrame, kind: str, updated_at: datetime, phrases: Phrases = ENGLISH,
    tz_offset_hours: int = fv.DEFAULT_TZ_OFFSET_HOURS, day: date | None = None,
) -> DataFrame:
    """The report text as ordered blocks, one row per item. No period is ever gathered in
    one row; ``BLOCK_ORDER`` is the order of the file."""
    rep = report(items, kind, tz_offset_hours, day, ordered=False)
    title = {DAILY: phrases.daily_title, WEEKLY: phrases.weekly_title, ALLTIME: phrases.alltime_title}[kind]
    shown = F.replace("period", F.lit("_"), F.lit(" – "))
    stamp = F.lit(updated_at.strftime("%Y-%m-%d %H:%M:%S"))
    head = F.concat(
        F.lit("# "), fill(title, period=shown), F.lit("\n\n"),
        fill(phrases.total_line, n=F.col("n")), F.lit("\n\n"),
        fill(phrases.updated_line, at=stamp),
        F.lit(f"\n\n{phrases.stats_headings[kind]}\n\n{phrases.by_source_heading}\n"),
    )
    detail = F.concat(
        F.lit("### ["), F.col("title"), F.lit("]("), F.col("link"), F.lit(")\n\n"),
        fill(phrases.site_line, site=F.col("site_name")), F.lit("\n"),
        fill(phrases.found_line, at=datetime_text(F.col("created_at"))), F.lit("\n"),
    )
    totals, sources = rep.totals, rep.by_source
    return (
        _block(totals, HEAD, head)
        .unionByName(
            _block(sources, SOURCES, fill(phrases.source_line, site=F.col("site_name"), n=F.col("n")),
                   neg_n=-F.col("n"), site_name=F.col("site_name"))
        )
        .unionByName(_block(totals, DETAIL_HEAD, F.lit(f"\n{phrases.detail_headings[kind]}\n")))
        .unionByName(
            _block(rep.items, DETAIL, detail,
                   neg_second=-F.unix_seconds("created_at"), neg_id=-F.col("id"))
        )
        .unionByName(_block(totals, FOOT, F.lit(f"\n---\n\n{phrases.footer}")))
    )


def write_blocks(blocks: DataFrame, folder: str) -> None:
    """One folder per period. Rows are range-partitioned in file order, so a large period is
    several part files whose names sort in reading order."""
    (
        blocks.repartitionByRange(*BLOCK_ORDER)
        .sortWithinPartitions(*BLOCK_ORDER)
        .select("period", F.col("block").alias("value"))
        .write.mode("overwrite").partitionBy("period").text(folder)
    )


def write_markdown_files(blocks: DataFrame, folder: str, kind: str) -> None:
    """P4 as one file per period, ``Daily_2024-01-07.md``, on a mounted folder; several tasks write a large one."""
    write_period_files(blocks, BLOCK_ORDER, folder, f"{kind.capitalize()}_", ".md")


FEED_DATE = "EEE, dd MMM yyyy HH:mm:ss Z"


def report_rss(
    items: DataFrame, kind: str, site_url: str, created_at: datetime, phrases: Phrases = ENGLISH,
    tz_offset_hours: int = fv.DEFAULT_TZ_OFFSET_HOURS, day: date | None = None,
) -> DataFrame:
    """P5: RSS 2.0 as ordered blocks per period: channel head, one element per item, tail."""
    rep = report(items, kind, tz_offset_hours, day, ordered=False)
    shown = F.replace("period", F.lit("_"), F.lit(" - "))
    made = F.date_format(utc_literal(created_at), FEED_DATE)
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" '
              'xmlns:content="http://purl.org/rss/1.0/modules/content/">\n<channel>\n'),
        _element("title", fill(phrases.feed_titles[kind], period=shown)),
        _element("link", F.lit(site_url)),
        _element("description", fill(phrases.feed_descriptions[kind], period=shown)),
        _element("pubDate", made),
    )
    item = F.concat(
        F.lit("<item>\n"),
        _element("title", F.col("title")),
        _element("link", F.col("link")),
        _element("description", effective_body(F.col("full_content"), F.col("content"))),
        _element("guid", F.concat("link", F.lit("_"), F.date_format("created_at", "yyyyMMddHHmmss"))),
        _element("pubDate", F.date_format("created_at", FEED_DATE)),
        F.lit("</item>"),
    )
    return (
        _block(rep.totals, HEAD, head)
        .unionByName(
            _block(rep.items, DETAIL, item, neg_second=-F.unix_seconds("created_at"), neg_id=-F.col("id"))
        )
        .unionByName(_block(rep.totals, FOOT, F.lit("</channel>\n</rss>")))
    )


NOT_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]"  # characters no XML 1.0 file may hold


def _element(name: str, value: Column) -> Column:
    text = F.regexp_replace(text_or_empty(value), NOT_XML, "\uFFFD")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return F.concat(F.lit(f"<{name}>"), text, F.lit(f"</{name}>\n"))


def write_rss(blocks: DataFrame, folder: str, kind: str) -> None:
    """A dated copy per period and a ``latest`` copy of the last period."""
    write_blocks(blocks, f"{folder}/{kind}_rss")
    last = blocks.agg(F.max("period").alias("period"))
    newest = blocks.join(F.broadcast(last), "period", "left_semi")  # the right side is one row
    write_blocks(newest, f"{folder}/latest_{kind}_rss")


def write_rss_files(blocks: DataFrame, folder: str, kind: str) -> None:
    """P5 as one well-formed feed file per period, ``daily_rss_2024-01-07.xml``, and ``latest_daily_rss.xml`` with the
    last period of ``blocks``, on a mounted folder; several tasks write a large one."""
    write_period_files(blocks, BLOCK_ORDER, folder, f"{kind}_rss_", ".xml", f"latest_{kind}_rss.xml")


def source_distribution(counts: DataFrame) -> DataFrame:
    """Each source's share of the largest one in percent, at least 1.5. ``counts`` holds
    one row per source, so the single window partition is as small as the catalogue."""
    largest = F.max("n").over(Window.partitionBy(F.lit(1)))
    share = F.greatest(F.col("n") / largest * 100, F.lit(fv.MIN_SHARE_PERCENT))
    return counts.select("site_name", "n", F.round(share, 4).alias("percent"))


def source_headline(counts: DataFrame) -> DataFrame:
    """Number of sources, the largest and its count; ties go to the first by name."""
    top = F.min(F.struct((-F.col("n")).alias("neg"), F.col("site_name")))
    return counts.agg(F.count(F.lit(1)).alias("sources"), top.alias("_top")).select(
        "sources", F.col("_top.site_name").alias("top_source"), (-F.col("_top.neg")).alias("top_count")
    )


def _table_rows(items: DataFrame, q: str, src: str) -> DataFrame:
    q = q.strip().lower()
    rows = items
    if q:
        rows = rows.filter(
            F.lower(text_or_empty(F.col("title"))).contains(q) | F.lower(text_or_empty(F.col("content"))).contains(q)
        )
    if src:
        rows = rows.filter(F.col("site_name") == src)
    return rows.select("id", "title", "link", "site_name", "created_at")


def _table_order(sort: str, asc: bool) -> list[Column]:
    order = [F.col("created_at").desc(), F.col("id").desc()]
    keys = {"title": F.lower("title"), "source": F.lower("site_name"), "time": F.col("created_at")}
    if sort:
        order.insert(0, keys[sort].asc() if asc else keys[sort].desc())
    return order


def report_table(
    items: DataFrame, q: str = "", src: str = "", sort: str = "", asc: bool = True
) -> DataFrame:
    """Filtered and sorted table rows with their new number and page of 50."""
    return number_rows(_table_rows(items, q, src), _table_order(sort, asc)).withColumn(
        "page", F.ceil(F.col("row_number") / F.lit(fv.TABLE_PAGE_ROWS)).cast("long")
    )


def write_report_table(
    items: DataFrame, path: str, q: str = "", src: str = "", sort: str = "", asc: bool = True,
    rows_per_file: int = ROWS_PER_FILE,
) -> None:
    """P8 as a stored table in its order, for any number of ``report_page`` reads."""
    write_paged(_table_rows(items, q, src), _table_order(sort, asc), path, rows_per_file)


def report_pages(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a stored P8 or P11 table with their number and page of 50."""
    return read_numbered(spark, path, fv.TABLE_PAGE_ROWS)


def report_page(spark: SparkSession, path: str, page: int) -> DataFrame:
    """One page of 50 rows of a stored P8 or P11 table; only the files that hold it are read."""
    return read_page(spark, path, page, fv.TABLE_PAGE_ROWS)


def topn_digest(
    items: DataFrame, analysis: DataFrame, day: date, n: int = fv.DEFAULT_DAILY_TOP_N,
    tz_offset_hours: int = fv.DEFAULT_TZ_OFFSET_HOURS,
) -> DataFrame:
    """Text lines (period, rank, line) of the best ``n`` items of a day."""
    top = top_scored_day(items, analysis, day, n if n > 0 else fv.DEFAULT_DAILY_TOP_N, tz_offset_hours)
    # at most n rows from here on
    rank = F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("id")))
    return top.select(
        period_of(DAILY, F.col("created_at"), tz_offset_hours).alias("period"),
        rank.alias("rank"),
        F.format_string(
            "\n%d. [%d/10] %s\n   %s\n   %s", rank, F.col("score"), F.col("title"), F.col("summary"), F.col("link")
        ).alias("line"),
    )


def digest_text(lines: DataFrame, phrases: Phrases = ENGLISH) -> DataFrame:
    """P9 lines as one (period, digest) text per day; a day has at most the top n lines."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda r: r["line"])
    head = fill(phrases.top_heading, n=F.count(F.lit(1)))
    return lines.groupBy("period").agg(F.concat(head, F.array_join(ordered, "")).alias("digest"))


def activity_share(
    items: DataFrame, now: datetime, tz_offset_hours: int = fv.DEFAULT_TZ_OFFSET_HOURS
) -> DataFrame:
    """P10: the seven days of Q15 relative to the largest of them (at least 1)."""
    days = last_7_days(items, now, tz_offset_hours)
    largest = F.greatest(F.max("n").over(Window.partitionBy(F.lit(1))), F.lit(1))
    return days.select("day", "label", "n", F.round(F.col("n") / largest, 6).alias("share"))


def _shown_rows(items: DataFrame) -> DataFrame:
    return items.select(
        "id", "title", "link", "site_name", "created_at",
        F.when(text_or_empty(F.col("content")) != "", preview(F.col("content"), fv.TABLE_PREVIEW_CHARS)).alias("preview"),
        site_badge(F.col("site_name")).alias("badge"),
        F.date_format("created_at", "MM-dd HH:mm").alias("time_label"),
    )


def report_table_rows(items: DataFrame) -> DataFrame:
    """Rows of the report table, newest first, already cut down before numbering."""
    return number_rows(_shown_rows(items), _table_order("", True))


def write_report_table_rows(items: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """P11 as a stored table, newest first, for any number of ``report_page`` reads."""
    write_paged(_shown_rows(items), _table_order("", True), path, rows_per_file)
