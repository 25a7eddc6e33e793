"""ST1: the poll cycle as a streaming query with at most one write per table and micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from signalsieve.functions import fixed_values as fv
from signalsieve.functions.fixed_values import DEFAULT_RULES, RuleBook
from signalsieve.functions.periods import day_bounds, in_range, local_today, utc_literal, week_bounds
from signalsieve.functions.phrases import ENGLISH, Phrases
from signalsieve.operators.alerts import (
    DAILY,
    WEEKLY,
    Channel,
    notice_alerts,
    notified_ids,
    pending_urgent_outbox,
    plain_item_alerts,
    render_outbox,
    report_notice,
    route_channels,
    select_alerts,
)
from signalsieve.operators.dedup import counters_of, dedup_links, fresh_items
from signalsieve.operators.inference import provider_chain
from signalsieve.operators.scoring import as_analysis, score_items
from signalsieve.operators.store import newest_analysis, with_analysis
from signalsieve.operators.triage import ANALYZE, triage
from signalsieve.plans.reports import digest_text, topn_digest
from signalsieve.schemas import RESULT, conform
from signalsieve.streaming.store import NOTICES, Store

DEFAULT_CHANNELS = (Channel("text", "text"),)


@dataclass(frozen=True)
class CycleSettings:
    """What a cycle needs to know. ``clock`` gives the time of a micro-batch; a replay must
    get the same time, so tests pass a fixed one."""

    clock: Callable[[int], datetime]
    max_age_days: int = 7
    notify_min_score: int = 5
    channels: Sequence[Channel] = DEFAULT_CHANNELS
    rules: RuleBook = field(default_factory=lambda: DEFAULT_RULES)
    phrases: Phrases = ENGLISH
    order: tuple[str, ...] = ("source_rank", "position")
    scorer: Callable[[DataFrame], DataFrame] | None = None  # items -> rows of score_items
    # items -> (item_id, provider, ord, json, error): answers of models in order, with the scorer behind them
    providers: Callable[[DataFrame], DataFrame] | None = None
    analyze: bool = True  # without it every fresh item becomes a plain message
    daily_notice: bool = False
    weekly_notice_on: int | None = None  # day of the week, 0 is Monday
    top_n: int = fv.DEFAULT_DAILY_TOP_N
    tz_offset_hours: int = fv.DEFAULT_TZ_OFFSET_HOURS


def identified(rows: DataFrame, created_at: Column) -> DataFrame:
    """Scanned rows as items: the id follows from the link, so a replay gives the same one."""
    return rows.withColumns({"id": F.xxhash64("link"), "created_at": created_at})


def run_cycle(batch: DataFrame, batch_id: int, store: Store, settings: CycleSettings) -> None:
    """One micro-batch: keep unseen links, store them, count them, set stale ones aside, triage, score, store the
    analysis, write the outbox and the notices that are due.

    What it reads of the history follows from the batch: the index buckets of its links, the urgent alerts left open
    by the batch before, and, once a local day, the items of the period that a notice is about."""
    now = settings.clock(batch_id)
    first_rows = dedup_links(batch, [F.col(c) for c in settings.order])
    unseen = first_rows.join(store.links.known(batch, before=batch_id), "link", "left_anti")
    store.write("items", unseen, batch_id)

    # from here on the written batch is the input, so nothing above is computed twice
    stored = store.read("items", batch=batch_id)
    fresh = fresh_items(stored, settings.max_age_days, now)
    counted = counters_of(batch, stored, settings.max_age_days, now).withColumn("counted_at", utc_literal(now))
    with _side_by_side(store.spark) as start:
        start(store.write, "counters", counted, batch_id)
        start(store.links.add, stored, batch_id, now)
        analyzed = start(store.write, "analysis", _analysis(fresh, batch_id, store, settings, now), batch_id)
        left_open = store.read("open_urgent", batch=store.last_batch(batch_id))
        analyzed.result()
        for table, rows in _alerts(fresh, stored, left_open, batch_id, store, settings, now):
            start(store.write, table, rows, batch_id)
        notices = _notices(batch_id, store, settings, now)
        if notices is not None:  # batches without any leave no folder, so that looking up what was sent stays short
            start(store.write, "notices", notices, batch_id)
    store.write("cycles", store.spark.range(0, 1, 1, 1).select(utc_literal(now).alias("done_at")), batch_id)


@contextmanager
def _side_by_side(spark: SparkSession) -> Iterator[Callable[..., Future]]:
    """Gives a function that starts jobs which need nothing of each other: a micro-batch is small, and one job after the
    other would leave most machines idle. All have ended behind the block, which raises what they raise."""
    running: list[Future] = []

    def start(job: Callable, *args) -> Future:
        running.append(pool.submit(inheritable_thread_target(spark)(job), *args))
        return running[-1]

    with ThreadPoolExecutor() as pool:
        yield start
    for job in running:
        job.result()


def _analysis(fresh: DataFrame, batch_id: int, store: Store, settings: CycleSettings, now: datetime) -> DataFrame:
    """Scores of the items that pass triage: the first valid answer of a provider, else the scorer's."""
    wanted = triage(fresh, settings.rules).filter(F.col("action") == ANALYZE)
    if not settings.analyze:
        wanted = wanted.limit(0)
    scored = settings.scorer(wanted) if settings.scorer else score_items(wanted, settings.rules, settings.phrases)
    if settings.providers is None:
        return as_analysis(scored, utc_literal(now))
    # answers are kept: they can be looked up later, and the chain below asks no model again
    store.write("answers", settings.providers(wanted), batch_id)
    chain = provider_chain(wanted, store.read("answers", batch=batch_id), scored, settings.phrases)
    return chain.select("item_id", *[F.col(f"result.{f.name}").alias(f.name) for f in RESULT.fields], "model_used",
                        utc_literal(now).alias("analyzed_at"))


def _alerts(
    fresh: DataFrame, stored: DataFrame, left_open: DataFrame, batch_id: int, store: Store, settings: CycleSettings,
    now: datetime,
) -> Iterator[tuple[str, DataFrame]]:
    """Outbox and notified rows of the batch, and the urgent alerts that it leaves open, each next to its table."""
    analysis = store.read("analysis", batch=batch_id)
    if settings.analyze:
        alerts = select_alerts(with_analysis(stored, analysis), settings.notify_min_score)
    else:
        alerts = plain_item_alerts(fresh)
    alerts = alerts.unionByName(left_open)  # every batch sends all that the one before has left open
    notified = notified_ids(alerts)
    yield "open_urgent", pending_urgent_outbox(stored, analysis, notified)
    yield "notified", notified
    yield "outbox", render_outbox(route_channels(alerts, settings.channels), utc_literal(now), settings.phrases)


def _notices(batch_id: int, store: Store, settings: CycleSettings, now: datetime) -> DataFrame | None:
    """Notices that are due: the daily one with the first batch of a local day, the weekly one with the first batch of
    its day of the week. The notices table says what was sent, so a restart or replay sends none twice."""
    today = local_today(now, settings.tz_offset_hours)
    wanted: list[tuple[str, date, tuple[datetime, datetime], str]] = []
    if settings.daily_notice:
        wanted.append((DAILY, today, day_bounds(today, settings.tz_offset_hours), today.isoformat()))
    if settings.weekly_notice_on == today.weekday():
        bounds = week_bounds(today, settings.tz_offset_hours)
        monday = date.fromordinal(today.toordinal() - today.weekday())
        sunday = date.fromordinal(monday.toordinal() + 6)
        wanted.append((WEEKLY, today, bounds, f"{monday}_{sunday}"))
    if not wanted:
        return None
    sent = store.read("notices", before=batch_id).filter(F.col("period").isin([w[3] for w in wanted]))
    known = {(r.kind, r.period) for r in sent.select("kind", "period").distinct().collect()}  # two at most
    out = None
    for kind, day, bounds, period in wanted:
        if (kind, period) in known:
            continue
        items = store.read("items").filter(in_range(F.col("created_at"), bounds))
        totals = items.agg(F.count(F.lit(1)).alias("n")).select(F.lit(period).alias("period"), "n")
        digest = None
        if kind == DAILY and settings.analyze:
            ids = items.select(F.col("id").alias("item_id"))
            analysis = newest_analysis(store.read("analysis").join(ids, "item_id", "left_semi"))
            digest = digest_text(topn_digest(items, analysis, day, settings.top_n, settings.tz_offset_hours), settings.phrases)
        notice = notice_alerts(report_notice(totals, kind, digest, settings.phrases))
        routed = render_outbox(route_channels(notice, settings.channels), utc_literal(now), settings.phrases)
        routed = conform(routed, NOTICES)
        out = routed if out is None else out.unionByName(routed)
    return out


def stream_cycle(
    stream: DataFrame, store: Store, settings: CycleSettings, trigger: dict | None = None
) -> StreamingQuery:
    """Starts ST1. ``trigger`` is ``{"availableNow": True}`` (default) or, for instance,
    ``{"processingTime": "2 hours"}``."""
    store.create()
    return (
        stream.writeStream.foreachBatch(lambda df, n: run_cycle(df, n, store, settings))
        .option("checkpointLocation", f"{store.root}/_checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
