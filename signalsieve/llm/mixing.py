"""Mixing sources to target weights by hash thresholds.

Every row gets a 64-bit hash. A source that owes ``rest`` more words than its whole repeats give takes
the rows whose hash lies below a threshold. The threshold comes from histograms: words are summed by
source and hash bucket, the running sum finds the bucket in which the budget is reached, and only that
bucket is split again by the next hash bits. Nothing is sorted, and budgets nest: a smaller budget of
the same source always takes a subset of the rows of a larger one.

Defined results: a null text has size 0; a null source is a source of its own, after all others; rows
that agree in hash (same id and text) are taken together or not at all; sources of size 0 get target
0; an empty table gives an empty result; reruns give the same rows. Input columns that carry the name
of an output column are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalsieve.llm.shared import WORD, cut, written
from signalsieve.operators.numbering import number_rows

BITS = 12  # hash bits that one histogram resolves
LEVELS = 5  # 60 of 64 bits; what agrees in all of them is taken together
SALTS = 32  # parts into which the rows of one source are dealt when thresholds meet them
BROADCAST_ROWS = 20_000  # source tables up to this many narrow rows (about 2 MB) are broadcast
MAX_REPEATS = 3
SEED = 20_240_101


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, cap: float = MAX_REPEATS) -> DataFrame:
    """Adds ``target`` to rows (source, source_size, weight): the sum of all sizes shared by weight,
    where no target exceeds ``cap`` times its source's size and any excess is shared again.

    Each turn is one aggregate over the source table; it ends when no further source is full.
    """
    limit = F.lit(float(cap)) * F.col("source_size")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double")).first()[0]
    level, full_before = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= limit
        given, open_weight, n_full = sources.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).cast("double"),
            F.count_if(full),
        ).first()
        if n_full == full_before or not open_weight:
            break
        level, full_before = (total - given) / open_weight, n_full
    return sources.withColumn("target", F.least(limit, F.col("weight") * F.lit(level)))


def _meet(rows: DataFrame, few: DataFrame, n_few: int) -> DataFrame:
    """Inner join on source_key of many rows with one or a few rows a source.

    The small side is broadcast while its counted rows are within BROADCAST_ROWS. Beyond that, the rows
    of each source are dealt over SALTS parts, so that a source with a third of all rows is not one task.
    """
    if n_few <= BROADCAST_ROWS:
        return rows.join(F.broadcast(few), "source_key")
    salt = F.pmod(F.col("h"), F.lit(SALTS)).cast("int")
    spread = few.select("*", F.explode(F.array([F.lit(i) for i in range(SALTS)])).alias("_salt"))
    return rows.withColumn("_salt", salt).join(spread, ["source_key", "_salt"]).drop("_salt")


def _digit(level: int) -> Column:
    """The hash bits that histogram ``level`` resolves, most significant first."""
    return F.shiftrightunsigned(F.col("h"), 64 - BITS * (level + 1)).bitwiseAND(F.lit((1 << BITS) - 1))


def _path(level: int) -> Column:
    """The hash bits above those of ``level``."""
    return F.lit(0).cast("long") if level == 0 else F.shiftrightunsigned(F.col("h"), 64 - BITS * level)


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, budget id, ``stop``): rows of the source with ``h`` above ``stop``'s bits are out.

    ``rows``: source_key, size, h. ``budgets``: source_key, budget_id, rest (words). The result has
    ``stop``, a path of LEVELS * BITS bits: rows whose own path is below it are in the budget. The row at
    the edge is in if that comes nearer to the budget than leaving it out.
    """
    n_budgets = budgets.count()
    state = budgets.select("source_key", "budget_id", F.col("rest").cast("double"),
                           F.lit(0).cast("long").alias("path"))
    for level in range(LEVELS):
        inside = _meet(rows, state, n_budgets).where(_path(level) == F.col("path"))
        sums = inside.groupBy("source_key", "budget_id", _digit(level).alias("digit")).agg(
            F.sum("size").alias("words"))
        running = Window.partitionBy("source_key", "budget_id").orderBy("digit")
        before = (F.sum("words").over(running) - F.col("words")).alias("before")
        # the last bucket that the budget still reaches: its predecessors fit, it may not
        reached = (
            sums.select("source_key", "budget_id", "digit", "words", before)
            .join(state.select("source_key", "budget_id", "rest"), ["source_key", "budget_id"])
            .where(F.col("before") <= F.col("rest"))
            .groupBy("source_key", "budget_id")
            .agg(F.max(F.struct("digit", "before", "words")).alias("edge"))
        )
        state = cut(
            state.join(reached, ["source_key", "budget_id"], "left").select(
                "source_key", "budget_id",
                (F.col("rest") - F.coalesce("edge.before", F.lit(0))).alias("rest"),
                (F.shiftleft("path", BITS) + F.coalesce("edge.digit", F.lit(0))).alias("path"),
                F.col("edge.words").alias("edge_words"),
            )
        )
    nearer_with = F.coalesce(2 * F.col("rest") > F.col("edge_words"), F.lit(False)).cast("long")
    return state.select("source_key", "budget_id", (F.col("path") + nearer_with).alias("stop"))


def _source_key(source: str) -> Column:
    """A key that is never null and orders by code point with null last."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))


def _hash(key: Sequence[str], text: str) -> Column:
    return F.xxhash64(F.lit(SEED), *key, F.col(text))


def _repeats(cap: int) -> Column:
    """Times that the plan takes a row with hash h."""
    under = F.shiftrightunsigned(F.col("h"), 64 - BITS * LEVELS) < F.col("stop")
    return F.least(F.col("whole") + F.when(under, 1).otherwise(0), F.lit(cap)).cast("int")


def _plan(
    df: DataFrame, key: Sequence[str], source: str, text: str, weight: Callable[[Column], Column], cap: int
) -> tuple[DataFrame, DataFrame]:
    """(narrow rows, plan): the plan has one row a source, with the whole repeats and the threshold."""
    rows = written(
        df.select(*key, _source_key(source).alias("source_key"), word_count(F.col(text)).alias("size"),
                  _hash(key, text).alias("h")),
        "mix-rows",
    )
    totals = rows.groupBy("source_key").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = number_rows(totals, [F.col("source_key")], "rank")
    sources = cut(water_fill(cut(ranked.withColumn("weight", weight(F.col("rank")).cast("long"))), cap))
    owed = sources.withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    ).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    stops = thresholds(rows.where("size > 0"), owed.select("source_key", F.lit(0).alias("budget_id"), "rest"))
    return rows, cut(owed.join(stops.drop("budget_id"), "source_key").select(
        "source_key", "source_size", "weight", "target", "whole", "stop"))


def _by_threes(rank: Column) -> Column:
    """1, 2, 3, 1, 2, 3, ... by rank."""
    return F.pmod(rank - 1, F.lit(3)) + 1


def mix(
    df: DataFrame, key: Sequence[str] = ("doc_id",), source: str = "source", text: str = "text",
    weight: Callable[[Column], Column] = _by_threes, cap: int = MAX_REPEATS,
) -> DataFrame:
    """One row per input row: ``key``, source, size, source_size, weight, target, taken, h.

    ``weight`` maps a source's rank (1, 2, ... by code point, null last) to its weight. ``taken`` counts
    repeats: whole repeats of the source plus one more for rows under its threshold; no row is taken
    more than ``cap`` times.
    """
    rows, plan = _plan(df, key, source, text, weight, cap)
    return _meet(rows, plan, plan.count()).select(
        *key,
        F.when(F.col("source_key") != "1", F.substring("source_key", 2, 1 << 30)).alias(source),
        "size", "source_size", "weight", "target", (F.col("size") * _repeats(cap)).cast("long").alias("taken"), "h",
    )


def mixed_corpus(
    df: DataFrame, key: Sequence[str] = ("doc_id",), source: str = "source", text: str = "text",
    weight: Callable[[Column], Column] = _by_threes, cap: int = MAX_REPEATS,
) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it, with all their columns."""
    _, plan = _plan(df, key, source, text, weight, cap)
    whole = df.select(F.struct("*").alias("_row"), _source_key(source).alias("source_key"), _hash(key, text).alias("h"))
    times = _meet(whole, plan.select("source_key", "whole", "stop"), plan.count())
    return times.select("_row", F.explode(F.array_repeat(F.lit(1), _repeats(cap))).alias("_time")).select("_row.*")
