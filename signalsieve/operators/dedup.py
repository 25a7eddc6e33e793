"""Dedup by link, freshness, and the incremental filters around the item table."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalsieve.functions.periods import utc_literal

# The date format of pub_date; anything else counts as no date.
RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"


def new_items(batch: DataFrame, items: DataFrame) -> DataFrame:
    """Rows whose link is not stored yet.

    Only the link column of the stored table is read. Run D2 first: with distinct links
    in the batch no join key can be hot.
    """
    return batch.join(items.select("link"), "link", "left_anti")


def new_items_of_small_batch(
    batch: DataFrame, items: DataFrame, links: DataFrame | None = None
) -> DataFrame:
    """D1 for a batch far smaller than the store.

    The store is reduced to the links of the batch first, so that the runtime may
    broadcast the batch's links (by measured size) and the store is never shuffled.
    ``links`` may name a cheaper frame with the same links, such as the batch before D2.
    """
    wanted = (links if links is not None else batch).select("link").distinct()
    seen = items.select("link").join(wanted, "link", "left_semi")
    return batch.join(seen, "link", "left_anti")


def dedup_links(
    batch: DataFrame, order: list[Column] | None = None
) -> DataFrame:
    """One row per link, the lowest (source rank, position).

    ``row_number() = 1`` is pruned inside each task before the shuffle, so a link that
    fills a third of the batch moves one row per task.
    """
    order = order or [F.col("source_rank"), F.col("position")]
    rank = F.row_number().over(Window.partitionBy("link").orderBy(*order))
    return batch.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def dedup_links_of_wide_rows(
    batch: DataFrame, id_col: str = "id", order: list[Column] | None = None
) -> DataFrame:
    """D2 for rows with long texts and few repeats: the texts stay where they are.

    Winners are found on (id, link, order) alone. The rest are the losers; when they are few,
    the runtime broadcasts their ids (by measured size) and the wide rows are filtered in
    place, else both sides meet on the id, which is never skewed. Reads ``batch`` twice, so
    it should be a table rather than a long plan.
    """
    order = order or [F.col("source_rank"), F.col("position")]
    narrow = batch.select(id_col, "link", *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    winners = dedup_links(narrow, [F.col(f"_o{i}") for i in range(len(order))]).select(id_col)
    losers = narrow.select(id_col).join(winners, id_col, "left_anti")
    return batch.join(losers, id_col, "left_anti")


def insert_ignore(items: DataFrame, batch: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """D3: the item table after the batch; known links and repeats are left out.

    Stale rows are stored as well, so that they stay known.
    """
    fresh = new_items(dedup_links(batch, order), items)
    return items.unionByName(fresh.select(*items.columns))


def published_at(pub_date: Column) -> Column:
    """Publication time; null for empty or unreadable dates."""
    # a comma may stand before the fraction; the cast knows the point only
    return F.when(pub_date.rlike(RFC3339), F.try_to_timestamp(F.replace(pub_date, F.lit(","), F.lit("."))))


def is_fresh(pub_date: Column, max_age_days: int, now: datetime) -> Column:
    """D4 as a predicate: no usable date counts as fresh; the cutoff itself is stale."""
    if max_age_days <= 0:
        return F.lit(True)
    cutoff = utc_literal(now - timedelta(days=max_age_days))
    return F.coalesce(published_at(pub_date) > cutoff, F.lit(True))


def fresh_items(df: DataFrame, max_age_days: int, now: datetime) -> DataFrame:
    """Rows young enough to be scored."""
    return df.filter(is_fresh(F.col("pub_date"), max_age_days, now))


def ingest_counters(
    batch: DataFrame, items: DataFrame, max_age_days: int, now: datetime,
    order: list[Column] | None = None,
) -> DataFrame:
    """Per source how many rows were fetched, new, stale and fresh."""
    order = order or [F.col("source_rank"), F.col("position")]
    # keep only what the counters need before the rows move
    narrow = batch.select("link", "site_name", "pub_date", *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    unseen = new_items(dedup_links(narrow, [F.col(f"_o{i}") for i in range(len(order))]), items)
    return counters_of(batch, unseen, max_age_days, now)


def counters_of(batch: DataFrame, unseen: DataFrame, max_age_days: int, now: datetime) -> DataFrame:
    """D5 where the new rows of the batch are at hand."""
    fetched = batch.groupBy("site_name").agg(F.count(F.lit(1)).alias("fetched"))
    fresh = is_fresh(F.col("pub_date"), max_age_days, now)
    counted = unseen.groupBy("site_name").agg(
        F.count(F.lit(1)).alias("new"),
        F.count_if(~fresh).alias("stale"),
        F.count_if(fresh).alias("fresh"),
    )
    zero = F.lit(0).cast("long")
    return fetched.join(counted, "site_name", "left").select(
        "site_name",
        "fetched",
        *[F.coalesce(F.col(n), zero).alias(n) for n in ("new", "stale", "fresh")],
    )


def exists_link(items: DataFrame, links: DataFrame) -> DataFrame:
    """Every given link with whether it is stored."""
    # distinct, so that the join cannot multiply rows
    stored = items.select("link").distinct().withColumn("_hit", F.lit(True))
    return links.join(stored, "link", "left").select(
        *links.columns, F.coalesce(F.col("_hit"), F.lit(False)).alias("is_stored")
    )


def pending_analysis(items: DataFrame, analysis: DataFrame) -> DataFrame:
    """Items that have no analysis."""
    return items.join(analysis.select(F.col("item_id").alias("id")), "id", "left_anti")
