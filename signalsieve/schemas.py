"""Fixed schemas of the stored tables and of the inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_TEXTS = ArrayType(StringType())


def _struct(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields])


ITEMS = _struct(
    ("id", LongType()),
    ("title", StringType()),
    ("link", StringType()),
    ("pub_date", StringType()),
    ("author", StringType()),
    ("category", StringType()),
    ("content", StringType()),
    ("full_content", StringType()),
    ("download_links", _TEXTS),
    ("site_name", StringType()),
    ("created_at", TimestampType()),
)

RESULT = _struct(
    ("score", IntegerType()),
    ("category", StringType()),
    ("tags", _TEXTS),
    ("summary", StringType()),
    ("affected_targets", _TEXTS),
    ("estimated_records", IntegerType()),
    ("data_types", _TEXTS),
    ("is_urgent", BooleanType()),
    ("confidence_level", StringType()),
    ("reasoning", StringType()),
)

ANALYSIS = StructType(
    [StructField("item_id", LongType())]
    + RESULT.fields
    + [StructField("model_used", StringType()), StructField("analyzed_at", TimestampType())]
)

NOTIFIED = _struct(("item_id", LongType()))

VICTIMS_LIVE = _struct(
    *[(n, StringType()) for n in
      ("victim", "group", "attackdate", "claim_url", "description", "country", "activity")]
)
VICTIMS_WATCH = _struct(*[(n, StringType()) for n in ("post_title", "group_name", "discovered")])
VICTIMS_LOOK = _struct(
    *[(n, StringType()) for n in
      ("post_title", "discovered", "description", "link", "group_name", "country")]
)

# defaults of columns that older tables may lack
_ITEM_DEFAULTS = {"full_content": "", "download_links": None, "content": "", "author": "",
                  "category": "", "pub_date": ""}


def conform(df: DataFrame, schema: StructType, defaults: dict | None = None) -> DataFrame:
    """Columns in schema order; missing ones are added with their default."""
    defaults = _ITEM_DEFAULTS if defaults is None else defaults
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
