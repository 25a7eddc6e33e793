"""Victim lists (JSON arrays) to items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from signalsieve import schemas
from signalsieve.functions import fixed_values as fv
from signalsieve.functions.text import first_filled, text_or_empty


def read_victims(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON files, one array each, as the (site_name, json) rows that S2 to S4 take.

    A file is one row; its name without the ending is the site.
    """
    files = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return files.select(name.alias("site_name"), F.col("value").alias("json"))


def explode_payloads(payloads: DataFrame, schema: StructType) -> DataFrame:
    """(site_name, json) rows to records with their ``position`` in the array."""
    records = F.from_json("json", ArrayType(schema))
    return payloads.select("site_name", F.posexplode(records).alias("position", "r")).select(
        "site_name", "position", "r.*"
    )


def _text(name: str) -> Column:
    return text_or_empty(F.col(name))


def _title(group: str, victim: str) -> Column:
    return F.concat(F.lit("["), F.upper(_text(group)), F.lit("] "), _text(victim))


def _slug(name: str) -> Column:
    return F.replace(F.lower(_text(name)), F.lit(" "), F.lit("-"))


def _in_front(name: str, content: Column) -> Column:
    mark = F.concat(F.lit("["), F.col(name), F.lit("] "), content)
    return F.when(_text(name) != "", mark).otherwise(content)


def _as_items(records: DataFrame, title: Column, link: Column, pub_date: Column, content: Column) -> DataFrame:
    return records.select(
        title.alias("title"),
        link.alias("link"),
        pub_date.alias("pub_date"),
        F.lit("").alias("author"),
        F.lit(fv.VICTIM_CATEGORY).alias("category"),
        content.alias("content"),
        F.lit("").alias("full_content"),
        F.array().cast("array<string>").alias("download_links"),
        "site_name",
        "position",
    )


def scan_victims_live(payloads: DataFrame) -> DataFrame:
    """Claims with group, country and activity."""
    rows = explode_payloads(payloads, schemas.VICTIMS_LIVE)
    country = F.when(_text("country") != "", F.concat(F.lit(" ("), F.col("country"), F.lit(")"))).otherwise("")
    return _as_items(
        rows,
        F.concat(_title("group", "victim"), country),
        first_filled(F.col("claim_url"), F.lit(fv.VICTIMS_LIVE_LINK)),
        _text("attackdate"),
        _in_front("activity", _text("description")),
    )


def scan_victims_look(payloads: DataFrame) -> DataFrame:
    """S3: posts with an optional link; a link is made from group and title when absent."""
    rows = explode_payloads(payloads, schemas.VICTIMS_LOOK).filter(
        (_text("post_title") != "") & (_text("group_name") != "")
    )
    made = F.concat(F.lit(fv.VICTIMS_LOOK_PREFIX), F.lower(_text("group_name")), F.lit("#"), _slug("post_title"))
    return _as_items(
        rows,
        _title("group_name", "post_title"),
        first_filled(F.col("link"), made),
        _text("discovered"),
        _in_front("country", _text("description")),
    )


def scan_victims_watch(payloads: DataFrame, limit: int = 0) -> DataFrame:
    """All posts of each list, or its first ``limit`` (newest first in the file)."""
    rows = explode_payloads(payloads, schemas.VICTIMS_WATCH)
    if limit > 0:
        rows = rows.filter(F.col("position") < limit)
    rows = rows.filter(_text("post_title") != "")
    return _as_items(
        rows,
        _title("group_name", "post_title"),
        F.concat(F.lit(fv.VICTIMS_WATCH_PREFIX), F.lower(_text("group_name")), F.lit("/"), _slug("post_title")),
        _text("discovered"),
        F.concat(
            F.lit("Ransomware group "), _text("group_name"), F.lit(" claimed victim: "), _text("post_title")
        ),
    )
