"""The source catalogue from its documents to the live, enabled sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalsieve.operators.catalog import (
    alive_sources,
    first_live_endpoint,
    merge_discovered,
    merge_sources,
    probe_candidates,
    toggle_sources,
)
from signalsieve.sources.directories import directory_links, named_feed_map, outline_feeds, table_feed_urls


@dataclass(frozen=True)
class DirectoryDocuments:
    """Directory documents as read: numbered lines, feed maps and outline texts."""

    forum_lines: DataFrame
    ransom_lines: DataFrame
    market_lines: DataFrame
    feed_maps: DataFrame
    outlines: DataFrame


def _pair(first):
    return F.struct(first.cast("bigint").alias("first"), F.lit(0).cast("bigint").alias("second"))


def _listed(df: DataFrame, *order: str) -> DataFrame:
    """Sources with a ``position`` that follows the given order; only comparisons of it
    count, so it may have gaps."""
    first, second = F.col(order[0]).cast("bigint"), F.col(order[1] if len(order) > 1 else order[0]).cast("bigint")
    place = F.struct(first.alias("first"), second.alias("second"))
    return df.select("name", "rss_url", F.lit(True).alias("enabled"), place.alias("position"))


def discovered_sources(docs: DirectoryDocuments, probes: DataFrame) -> DataFrame:
    """All discovery outputs; the list order decides between equal names."""
    def live(lines: DataFrame, mode: str) -> DataFrame:
        links = directory_links(lines, mode)
        found = first_live_endpoint(probe_candidates(links.select("name", "base")), probes)
        return found.join(links.select("base", "line_no", "ord"), "base")

    maps = named_feed_map(docs.feed_maps).select(
        # a map has no order of its own; its keys give one
        "name", "rss_url", F.lit(True).alias("enabled"), _pair(F.xxhash64("feed_key")).alias("position")
    )
    lists = [
        _listed(live(docs.forum_lines, "same_cell"), "line_no", "ord"),
        _listed(table_feed_urls(docs.ransom_lines), "line_no", "cell"),
        _listed(live(docs.market_lines, "next_cell"), "line_no", "ord"),
        maps,
        _listed(outline_feeds(docs.outlines), "position"),
    ]
    return merge_discovered(lists).withColumn("enabled", F.lit(True))


def resolve_sources(
    seed: DataFrame,
    discovered: DataFrame,
    local: DataFrame,
    remote: DataFrame,
    toggles: DataFrame | None = None,
    probes: DataFrame | None = None,
) -> DataFrame:
    """Merged and enabled sources; with ``probes`` only the live ones. Toggles switch the
    locally configured sources before the merge."""
    if toggles is not None:
        local = toggle_sources(local, toggles)
    # discovered names are distinct already, so their position decides nothing any more
    found = discovered.select("name", "rss_url", "enabled", F.lit(0).alias("position"))
    merged = merge_sources(seed, found, local, remote)
    return alive_sources(merged, probes) if probes is not None else merged
