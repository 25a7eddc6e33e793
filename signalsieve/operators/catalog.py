"""The catalogue of feeds: merging lists of sources, probing decisions, toggles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalsieve.functions import fixed_values as fv
from signalsieve.functions.matching import any_contains
from signalsieve.functions.text import normalize_key, text_or_empty

# Which list beats which.
PRIORITY = {"discovered": 0, "seed": 1, "local": 2, "remote": 3}


def merge_sources(
    seed: DataFrame, discovered: DataFrame, local: DataFrame, remote: DataFrame
) -> DataFrame:
    """Remote over local over seed over discovered, by normalised name; then the
    enabled ones. A disabled winner therefore hides the enabled rows below it.

    Within one list the last row of a name wins (``position``), but the first one among
    the discovered. Inputs hold name, rss_url, enabled, position.
    """
    columns = ["name", "rss_url", "enabled", "position"]
    has_url = text_or_empty(F.col("rss_url")) != ""
    named = text_or_empty(F.col("name")) != ""
    parts = {
        "discovered": discovered.withColumn("position", -F.col("position")),
        "seed": seed,
        "local": local.filter(has_url),
        "remote": remote.filter(has_url & named),
    }
    union = None
    for origin, df in parts.items():
        rows = df.select(*columns, F.lit(origin).alias("origin"), F.lit(PRIORITY[origin]).alias("_prio"))
        union = rows if union is None else union.unionByName(rows)
    keyed = union.withColumn("source_key", normalize_key(text_or_empty(F.col("name"))))
    order = Window.partitionBy("source_key").orderBy(F.col("_prio").desc(), F.col("position").desc())
    return (
        keyed.withColumn("_rank", F.row_number().over(order))
        .filter((F.col("_rank") == 1) & F.col("enabled"))
        .select("source_key", "name", "rss_url", "origin")
    )


def merge_discovered(lists: Sequence[DataFrame]) -> DataFrame:
    """All discovery outputs, first by normalised name; the order of ``lists`` and
    ``position`` inside a list decide."""
    union = None
    for rank, df in enumerate(lists):
        rows = df.select("name", "rss_url", "position", F.lit(rank).alias("list_rank"))
        union = rows if union is None else union.unionByName(rows)
    keyed = union.withColumn("source_key", normalize_key(text_or_empty(F.col("name"))))
    order = Window.partitionBy("source_key").orderBy("list_rank", "position")
    return keyed.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def probe_candidates(bases: DataFrame, paths: Sequence[str] = tuple(fv.FEED_PATHS)) -> DataFrame:
    """Every base with every path, in path order. The paths are configuration, so this
    is an explode of a literal array."""
    return bases.select(
        "*", F.posexplode(F.array(*[F.lit(p) for p in paths])).alias("path_ord", "path")
    ).withColumn("url", F.concat("base", "path"))


def is_feed_payload(status: Column, body: Column, head_chars: int = 0) -> Column:
    """C11: a good status and a feed marker in the body, or in its first ``head_chars`` characters."""
    text = text_or_empty(body)
    looked_at = F.substring(text, 1, head_chars) if head_chars > 0 else text
    return F.coalesce(status < 400, F.lit(False)) & any_contains(looked_at, fv.FEED_MARKERS)


def first_live_endpoint(candidates: DataFrame, probes: DataFrame) -> DataFrame:
    """Per base the first path that answered with a feed; bases without one drop out."""
    live = probes.filter(is_feed_payload(F.col("status"), F.col("body"))).select("url").distinct()
    return (
        candidates.join(live, "url", "left_semi")
        .groupBy("name", "base")
        .agg(F.min_by("url", "path_ord").alias("rss_url"))
    )


def alive_sources(sources: DataFrame, probes: DataFrame) -> DataFrame:
    """Internal sources always stay, the others need a live probe."""
    live = probes.filter(is_feed_payload(F.col("status"), F.col("body"))).select(F.col("url").alias("rss_url"))
    internal = F.col("rss_url").startswith(fv.INTERNAL_SCHEME)
    probed = sources.filter(~internal).join(live, "rss_url", "left_semi").select(*sources.columns)
    return sources.filter(internal).unionByName(probed)


def toggle_key(name: Column) -> Column:
    return F.upper(F.replace(name, F.lit("."), F.lit("_")))


def toggle_sources(sources: DataFrame, toggles: DataFrame) -> DataFrame:
    """Per-source switch; ``toggles`` holds (toggle_key, enabled). Of several toggles of one key,
    off wins."""
    switch = toggles.groupBy(F.col("toggle_key").alias("_key")).agg(F.bool_and("enabled").alias("_on"))
    return (
        sources.join(switch, toggle_key(F.col("name")) == F.col("_key"), "left")
        .withColumn("enabled", F.coalesce("_on", "enabled"))
        .select(*sources.columns)
    )
