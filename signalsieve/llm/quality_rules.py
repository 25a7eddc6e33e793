"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

``text_measures`` gives the quantities that rules look at. Rules are expressions over them; ``measured_order`` times
each on a sample of the whole table and orders them by what they reject per unit of cost, and the cascade tests
them in that order until one rejects. The order changes the time a document takes, never its verdict.

``good`` puts the measures' own expressions into the rules: a costly measure (``n_repeat_words``) is
computed only for documents that the rules before it keep. ``judge`` returns all measures, so there the rules
compare what is computed anyway, in the same order.

Defined results: a null or empty text has no words and fails the base rules. Repeated rows and
equal ids get a verdict each. An empty table gives an empty table. Input columns that carry the
name of an output column are left out; other columns pass through when ``keep`` names them.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalsieve.llm.shared import WHITE, WORD, written

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SAMPLE_ROWS = 2_000
SAMPLE_FILES = 8


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a document that the rule turns away (null counts as false)."""

    name: str
    rejects: Column


def _repeat_starts(tri: Column) -> Column:
    """Ascending starts of the windows whose value occurs more than once."""
    order = F.sort_array(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = F.filter(
            s,
            lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]),
        )
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    return _bind(order, starts)


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: a lambda variable is bound to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _covered(starts: Column, width: int) -> Column:
    """Positions covered by windows of ``width`` at ascending ``starts``."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last")),
        lambda acc, p: F.struct(
            (acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"), p.alias("last")
        ),
        lambda acc: acc["n"],
    )


def repeat_words(words: Column, width: int = 3) -> Column:
    """Words inside windows of ``width`` that occur at least twice in the text.

    Windows are compared by a 64-bit hash of their words. Only texts with an equal pair of
    windows pay for the sort.
    """
    n = F.size(words)
    parts = [F.slice(words, k + 1, F.greatest(n - F.lit(width - 1), F.lit(0))) for k in range(width)]
    tri = F.transform(F.arrays_zip(*parts), lambda s: F.xxhash64(s))

    def count(t: Column) -> Column:
        return F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0).cast("long")).otherwise(
            _bind(_repeat_starts(t), lambda s: _covered(s, width))
        )

    return F.when(n <= F.lit(width), F.lit(0).cast("long")).otherwise(_bind(tri, count))


def words_of(text: Column) -> Column:
    """The words of a text, in order: runs of anything but ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{WHITE}]+"), lambda w: w != "")


def _dup_lines(body: Column) -> Column:
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    return _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def measures(text: Column, words: Column) -> dict[str, Column]:
    """The MEASURES as expressions over a text (not null) and its words, as longs."""
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.concat_ws("", words)).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]++", "")).cast("long"),
        "n_dup_lines": _dup_lines(text),
        "n_repeat_words": repeat_words(words),
    }


def _worded(df: DataFrame, keep: Sequence[str] = (), text: str = "text") -> DataFrame:
    """``keep``, ``_text`` and ``_words``, made by a generator, so that no later step spells them out again."""
    body = F.coalesce(F.col(text), F.lit("")).alias("_text")
    return df.select(*keep, F.inline(F.array(F.struct(body, words_of(F.col(text)).alias("_words")))))


def text_measures(df: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` and the five MEASURES of the whole text, as longs. One scan, no shuffle."""
    rest = [c for c in keep if c not in MEASURES]
    base, found = _worded(df, rest, text), measures(F.col("_text"), F.col("_words"))
    return base.select(*rest, F.inline(F.array(F.struct(*[found[m].alias(m) for m in MEASURES]))))


def _named() -> dict[str, Column]:
    return {m: F.col(m) for m in MEASURES}


def base_rules(m: Mapping[str, Column]) -> list[Rule]:
    return [
        Rule("few_words", m["n_words"] < 50),
        Rule("repeated_words", 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    ]


def base_failed() -> Column:
    few, repeated = base_rules(_named())
    return few.rejects | repeated.rejects


def default_rules(m: Mapping[str, Column]) -> list[Rule]:
    """Rules over the measures ``m``. The bounds are wide: they turn away what is plainly not prose."""
    n = m["n_words"]
    return [
        Rule("symbol_heavy", 10 * m["n_symbols"] > n),
        Rule("short_words", m["word_chars"] < 2 * n),
        Rule("long_words", m["word_chars"] > 15 * n),
        Rule("repeated_lines", m["n_dup_lines"] * 20 > n),
    ]


def measured_order(
    df: DataFrame, rules: Sequence[Rule], sample_rows: int, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows
) -> list[Rule]:
    """``rules`` by rejections per second, ties by name, measured on about ``sample_rows`` rows of all of ``df``.

    ``prepare`` makes of the sampled rows what the rules look at. The sample is written once and spread over a few files; a rule's cost is the time of its job beyond that
    of a job without a rule. An empty sample keeps the given order.
    """
    total = df.count()
    if not total or len(rules) < 2:
        return list(rules)
    part = df.sample(min(1.0, sample_rows / total), seed=10) if total > sample_rows else df
    rows = written(prepare(part.repartition(SAMPLE_FILES)), "rules-sample")

    def timed(rejects: Column) -> tuple[int, float]:
        began = time.perf_counter()
        # counted in one column per row, so that no rule is folded away
        hits = rows.select(F.coalesce(rejects, F.lit(False)).alias("hit"), *rows.columns).agg(
            F.count_if("hit"), F.count(rows.columns[-1])).first()[0]
        return hits, time.perf_counter() - began

    none = F.rand(1) < 0
    timed(none)  # the first job also pays for starting
    overhead = timed(none)[1]
    rated = []
    for rule in rules:
        hits, seconds = timed(rule.rejects)
        rated.append((-hits / max(seconds - overhead, 1e-3), rule.name, rule))
    return [r for _, _, r in sorted(rated, key=lambda x: x[:2])]


def first_rejection(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects, or null; later rules are not evaluated."""
    out = None
    for rule in rules:
        out = F.when(rule.rejects, F.lit(rule.name)) if out is None else out.when(rule.rejects, F.lit(rule.name))
    return F.lit(None).cast("string") if out is None else out


def cascade(df: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Adds ``rejected_by`` to ``df``: the first rule, in the measured order, that rejects the row.

    ``sample_rows`` is about the number of rows the order is estimated on; every row is judged by every rule
    it takes to reject it.
    """
    return df.withColumn("rejected_by", first_rejection(measured_order(df, rules, sample_rows)))


def judge(
    df: DataFrame, keep: Sequence[str] = ("doc_id",),
    rules: Callable[[Mapping[str, Column]], Sequence[Rule]] = default_rules, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``keep``, MEASURES, ``base_failed`` and ``kept`` for every row."""
    found = measures(F.col("_text"), F.col("_words"))
    order = [r.name for r in measured_order(df.select("text"), rules(found), sample_rows, _worded)]
    named = {r.name: r for r in rules(_named())}
    failed = base_failed()
    return text_measures(df, keep).select(
        *[c for c in keep if c not in MEASURES], *MEASURES, failed.alias("base_failed"),
        (~failed & first_rejection([named[n] for n in order]).isNull()).alias("kept"),
    )


def good(
    df: DataFrame, rules: Callable[[Mapping[str, Column]], Sequence[Rule]] = default_rules,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """The rows of ``df`` that the base rules and the cascade keep, with all their columns."""
    found = measures(F.col("_text"), F.col("_words"))
    order = measured_order(df.select("text"), [*base_rules(found), *rules(found)], sample_rows, _worded)
    rows = _worded(df.select(F.struct("*").alias("_row"), "text"), ("_row",))
    return rows.where(first_rejection(order).isNull()).select("_row.*")
