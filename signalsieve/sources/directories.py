"""Source lists hidden in directory documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalsieve.functions import fixed_values as fv
from signalsieve.functions.matching import any_contains
from signalsieve.functions.text import first_filled, sanitize_name, text_or_empty

# Patterns of directory lines.
LINK_ONLINE_SAME_CELL = r"\[([^\]]+)\]\((https://[^)]+)\)[^|]*ONLINE"
LINK_ONLINE_NEXT_CELL = r"\[([^\]]+)\]\((https://[^)]+)\)[^|]*\|[\t\n\f\r ]*ONLINE"
FEED_URL = (
    r"""https?://[^\t\n\f\r |<>"]+\.(?:rss|xml|atom)"""
    r"""|https?://[^\t\n\f\r |<>"]+/(?:rss|feed|atom)/?(?:[^|\t\n\f\r <>"]*)?"""
)
CELL_NAME = r"\[([^\]]+)\]"
HIDDEN_SERVICE = ".onion"
TABLE_HEADER_LINES = 2
TABLE_SUFFIX = " (ransom)"
OUTLINE_TAG = r"""<outline(?:[\t\n\f\r ]+[\w:.-]+[\t\n\f\r ]*=[\t\n\f\r ]*(?:"[^"]*"|'[^']*'))*+[\t\n\f\r ]*/?>"""


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a directory document with their number (from 1). The document is one small
    file; it is read whole and cut in the row, so that the numbering is exact."""
    return (
        spark.read.text(path, wholetext=True)
        .select(F.posexplode(F.split("value", "\r?\n")).alias("_pos", "line"))
        .select((F.col("_pos") + 1).alias("line_no"), "line")
    )


def directory_links(lines: DataFrame, mode: str = "same_cell") -> DataFrame:
    """C4: named https links marked ONLINE, in the same cell or (``next_cell``) the next one;
    the first of each address wins."""
    pattern = LINK_ONLINE_NEXT_CELL if mode == "next_cell" else LINK_ONLINE_SAME_CELL
    # a line without the mark cannot match
    marked = lines.filter(F.col("line").contains("ONLINE"))
    found = marked.select(
        "line_no",
        F.posexplode(
            F.arrays_zip(
                F.regexp_extract_all("line", F.lit(pattern), F.lit(1)).alias("name"),
                F.regexp_extract_all("line", F.lit(pattern), F.lit(2)).alias("url"),
            )
        ).alias("ord", "m"),
    ).select("line_no", "ord", sanitize_name(F.col("m.name")).alias("name"),
             F.rtrim(F.col("m.url"), F.lit("/")).alias("base"))
    kept = found.filter(~F.col("base").contains(HIDDEN_SERVICE))
    first = Window.partitionBy("base").orderBy("line_no", "ord")
    return kept.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def table_feed_urls(lines: DataFrame) -> DataFrame:
    """Feed addresses in the cells of pipe-table rows marked ONLINE; first seen wins."""
    rows = lines.filter((F.col("line_no") > TABLE_HEADER_LINES) & F.col("line").contains("ONLINE")).withColumn(
        "cells", F.split("line", r"\|")
    )
    rows = rows.filter(F.size("cells") >= 5).withColumn(
        "cell_name", sanitize_name(F.regexp_extract(F.get("cells", F.lit(1)), CELL_NAME, 1))
    )
    urls = rows.select(
        "line_no", "cell_name", F.posexplode(F.transform("cells", lambda c: F.regexp_extract(c, FEED_URL, 0))).alias("cell", "rss_url")
    ).filter((F.col("rss_url") != "") & ~F.col("rss_url").contains(HIDDEN_SERVICE))
    first = Window.partitionBy("rss_url").orderBy("line_no", "cell")
    kept = urls.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")
    # a line without a name takes its first kept address for all its entries
    line_first = F.first("rss_url").over(Window.partitionBy("line_no").orderBy("cell"))
    return kept.withColumn("_fallback", line_first).select(
        F.concat(first_filled(F.col("cell_name"), F.col("_fallback")), F.lit(TABLE_SUFFIX)).alias("name"),
        "rss_url",
        F.lit(True).alias("enabled"),
        "line_no",
        "cell",
    )


def outline_feeds(opml: DataFrame, keywords: Sequence[str] = tuple(fv.OUTLINE_KEYWORDS)) -> DataFrame:
    """Outlines of any depth with a feed address and a relevant label. Each tag is taken
    on its own, so nesting does not matter; attribute values are decoded by the XML reader."""
    tags = opml.select(
        *[c for c in opml.columns if c != "opml"],
        F.posexplode(F.regexp_extract_all("opml", F.lit(OUTLINE_TAG), F.lit(0))).alias("position", "tag"),
    )
    closed = F.concat(F.regexp_replace("tag", r"[\t\n\f\r ]*/?>$", ""), F.lit("/>"))
    parsed = tags.withColumn(
        "o", F.from_xml(closed, "_text string, _title string, _xmlUrl string", {"attributePrefix": "_"})
    )
    label = F.lower(F.concat(text_or_empty(F.col("o._text")), F.lit(" "), text_or_empty(F.col("o._title"))))
    return parsed.filter((text_or_empty(F.col("o._xmlUrl")) != "") & any_contains(label, keywords)).select(
        *[c for c in opml.columns if c != "opml"],
        "position",
        text_or_empty(F.col("o._text")).alias("name"),
        F.col("o._xmlUrl").alias("rss_url"),
        F.lit(True).alias("enabled"),
    )


def named_feed_map(maps: DataFrame, map_col: str = "feeds") -> DataFrame:
    """A map from key to (rss_url, website_name) as sources."""
    return (
        maps.select(F.explode(map_col).alias("feed_key", "f"))
        .filter(text_or_empty(F.col("f.rss_url")) != "")
        .select(
            "feed_key",
            first_filled(F.col("f.website_name"), F.col("f.rss_url")).alias("name"),
            F.col("f.rss_url").alias("rss_url"),
            F.lit(True).alias("enabled"),
        )
    )
