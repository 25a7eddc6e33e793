"""Queries of the streaming operators. Each run drains the given tables as a stream into
a new folder below the checkpoint folder and returns what arrived there."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from signalsieve.operators.alerts import Channel
from signalsieve.registry.base import ITEMS, parts_cte, query, scored_cte, stamp, triage_cte
from signalsieve.registry.reports import LINE
from signalsieve.registry.store import _STALE
from signalsieve.registry.views import NOW, event_items, items_from, table
from signalsieve.session import ensure_checkpoint_dir
from signalsieve.streaming.cycle import CycleSettings, stream_cycle
from signalsieve.streaming.links import read_first_rows, write_first_rows
from signalsieve.streaming.retention import DayTable, write_retained
from signalsieve.streaming.store import Store
from signalsieve.streaming.windows import (
    read_counts, read_side, stream_counts, stream_dedup, stream_late, stream_retention, write_counts, write_split,
)

c = F.col


def new_folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def stream_of(spark, sf, name: str) -> DataFrame:
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/{name}*.parquet")


def drained(stream: DataFrame) -> DataFrame:
    """Everything the stream emits, once it has read all there is."""
    spark, folder = stream.sparkSession, new_folder(stream.sparkSession)
    run = (
        stream.writeStream.format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def cycle_store(spark, sf, **more) -> Store:
    store = Store(spark, new_folder(spark))
    channels = (Channel("text", "text"), Channel("mobile", "rich"))
    settings = CycleSettings(clock=lambda _: NOW, channels=channels, **more)
    stream_cycle(items_from(stream_of(spark, sf, "documents")), store, settings).awaitTermination()
    return store


_CYCLE = (
    ITEMS + "," + triage_cte("it") + f",\nwanted AS (SELECT * FROM tri WHERE action = 'analyze' AND NOT {_STALE}),"
    + parts_cte("wanted") + "," + scored_cte()
)


@query("st1_stream_cycle", f"""WITH {_CYCLE}
SELECT id AS item_id, title, link, CASE WHEN is_urgent THEN 'urgent' ELSE 'normal' END AS kind, score, ai_category AS category, channel
FROM scored, (VALUES ('text'), ('mobile')) ch(channel) WHERE score >= 5""")
def _(spark, sf):
    return cycle_store(spark, sf).read("outbox").select("item_id", "title", "link", "kind", "score", "category", "channel")


@query("st1_stream_cycle_tables", f"""WITH {_CYCLE}
SELECT 'items' AS side, id, link AS value FROM it
UNION ALL SELECT 'analysis', id, score || ' ' || summary FROM scored
UNION ALL SELECT 'notified', id, '' FROM scored WHERE score >= 5 AND is_urgent""")
def _(spark, sf):
    store = cycle_store(spark, sf)
    analysis = store.current_analysis()
    return (
        store.read("items").select(F.lit("items").alias("side"), "id", c("link").alias("value"))
        .unionByName(analysis.select(
            F.lit("analysis").alias("side"), c("item_id").alias("id"),
            F.concat_ws(" ", c("score").cast("string"), "summary").alias("value")))
        .unionByName(store.read("notified").select(F.lit("notified").alias("side"), c("item_id").alias("id"), F.lit("").alias("value")))
    )


@query("st1_stream_counters", f"""WITH {ITEMS}
SELECT f.site_name, f.fetched, count(it.id) AS new, count(it.id) FILTER (WHERE {_STALE}) AS stale,
  count(it.id) FILTER (WHERE NOT {_STALE}) AS fresh
FROM (SELECT site_name, count(*) AS fetched FROM it_all GROUP BY 1) f LEFT JOIN it ON it.site_name = f.site_name GROUP BY 1, 2""")
def _(spark, sf):
    return cycle_store(spark, sf).read("counters").drop("counted_at")


_TODAY = (NOW + timedelta(hours=8)).date()
_MONDAY = _TODAY - timedelta(days=_TODAY.weekday())
_WEEK = f"{_MONDAY}_{_MONDAY + timedelta(days=6)}"


@query("st1_stream_notices", f"""WITH {_CYCLE},
local AS (SELECT *, CAST(created_at + to_hours(8) AS DATE) AS day FROM it),
top AS (SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, score, title, summary, link FROM scored
  WHERE CAST(created_at + to_hours(8) AS DATE) = DATE '{_TODAY}' QUALIFY rank <= 20),
digest AS (SELECT chr(10) || chr(10) || '📊 Today''s top ' || count(*) || ':' || chr(10) || string_agg({LINE}, '' ORDER BY rank) AS text
  FROM top HAVING count(*) > 0),
sent AS (
  SELECT 'daily' AS kind, '{_TODAY}' AS period, 'Daily leak report {_TODAY}' AS title,
    (SELECT count(*) FROM local WHERE day = DATE '{_TODAY}') || ' leak items collected' || coalesce((SELECT text FROM digest), '') AS body
  UNION ALL SELECT 'weekly', '{_WEEK}', 'Weekly leak report {_WEEK}',
    (SELECT count(*) FROM local WHERE day BETWEEN DATE '{_MONDAY}' AND DATE '{_MONDAY + timedelta(days=6)}') || ' leak items collected'
)
SELECT kind, period, title, body, channel FROM sent, (VALUES ('text'), ('mobile')) ch(channel)""")
def _(spark, sf):
    store = cycle_store(spark, sf, daily_notice=True, weekly_notice_on=_TODAY.weekday())
    return store.read("notices").select("kind", "period", "title", "body", "channel")


_EVENTS = """ev AS (SELECT event_id AS id, 'https://example.org/e/' || user_id || '/' || event_type AS link,
  strftime(ts - to_days(CAST(event_id % 14 AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') AS pub_date, 'site' || (user_id % 20) AS site_name,
  date_trunc('second', ts) AS created_at FROM events)"""


def _events(spark, sf):
    return event_items(stream_of(spark, sf, "events"))


@query("st2_stream_dedup", f"WITH {_EVENTS} SELECT DISTINCT link FROM ev")
def _(spark, sf):
    return drained(stream_dedup(_events(spark, sf), "90 days").select("link"))


def _events_in_files(spark, sf) -> DataFrame:
    """The events as a stream of four files, so that later micro-batches bring smaller ids and older days."""
    landed = f"{new_folder(spark)}/in"
    events = table(spark, sf, "events")
    events.withColumn("part", c("event_id") % 4).repartition("part").write.partitionBy("part").parquet(landed)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{landed}/part=*")
    return event_items(stream)


@query("st2_stream_first_rows", f"""WITH {_EVENTS} SELECT link, id, site_name FROM ev
QUALIFY row_number() OVER (PARTITION BY link ORDER BY id) = 1""")
def _(spark, sf):
    rows, folder = _events_in_files(spark, sf), new_folder(spark)
    write_first_rows(rows, folder, lambda _: NOW, order=("id",), buckets=16).awaitTermination()
    return read_first_rows(spark, folder, rows.schema, order=("id",)).select("link", "id", "site_name")


@query("st3_stream_late", f"""WITH {_EVENTS}
SELECT id, site_name, strptime(pub_date, '%Y-%m-%dT%H:%M:%SZ') <= created_at - to_days(7) AS late FROM ev""")
def _(spark, sf):
    return drained(stream_late(_events(spark, sf), 7).select("id", "site_name", "late"))


def _split(spark, sf) -> tuple[str, StructType]:
    rows, folder = _events_in_files(spark, sf), new_folder(spark)
    write_split(rows, folder, 7).awaitTermination()
    return folder, rows.schema


_LATE = "strptime(pub_date, '%Y-%m-%dT%H:%M:%SZ') <= created_at - to_days(7)"


@query("st3_stream_late_side", f"WITH {_EVENTS} SELECT id, link, site_name FROM ev WHERE {_LATE}")
def _(spark, sf):
    folder, schema = _split(spark, sf)
    return read_side(spark, folder, schema, late=True).select("id", "link", "site_name")


@query("st3_stream_timely_side", f"WITH {_EVENTS} SELECT id, link, site_name FROM ev WHERE NOT coalesce({_LATE}, false)")
def _(spark, sf):
    folder, schema = _split(spark, sf)
    return read_side(spark, folder, schema, late=False).select("id", "link", "site_name")


def _window_sql(start: str, days: int) -> str:
    return f"""WITH {_EVENTS}, w AS (SELECT {start} - to_hours(8) AS s, site_name, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT {stamp('s')} AS window_start, {stamp(f's + to_days({days})')} AS window_end, site_name, n FROM w"""


def _counted(spark, sf, kind: str) -> DataFrame:
    folder = new_folder(spark)
    write_counts(_events(spark, sf), folder, kind).awaitTermination()
    return read_counts(spark, folder)


@query("st4_stream_daily_counts", _window_sql("CAST(CAST(created_at + to_hours(8) AS DATE) AS TIMESTAMP)", 1))
def _(spark, sf):
    return _counted(spark, sf, "daily")


@query("st4_stream_weekly_counts", _window_sql("CAST(date_trunc('week', created_at + to_hours(8)) AS TIMESTAMP)", 7))
def _(spark, sf):
    return _counted(spark, sf, "weekly")


@query("st4_batch_daily_counts", _window_sql("CAST(CAST(created_at + to_hours(8) AS DATE) AS TIMESTAMP)", 1))
def _(spark, sf):
    return stream_counts(event_items(table(spark, sf, "events")), "daily")


@query("st5_stream_retention", f"""WITH {_EVENTS} SELECT id, {stamp('created_at')} AS created_at FROM ev
WHERE created_at >= TIMESTAMP '{NOW}' - to_days(10)""")
def _(spark, sf):
    return drained(stream_retention(_events(spark, sf), 10, NOW).select("id", "created_at"))


@query("st5_stream_retained_table", f"""WITH {_EVENTS} SELECT id, link, {stamp('created_at')} AS created_at FROM ev
WHERE created_at >= TIMESTAMP '{NOW}' - to_days(10)""")
def _(spark, sf):
    rows, folder = _events_in_files(spark, sf), new_folder(spark)
    write_retained(rows, folder, 10, lambda _: NOW).awaitTermination()
    return DayTable(spark, folder, rows.schema).read().select("id", "link", "created_at")
