"""Substring matching as Column expressions.

Word lists travel as array literals under higher-order functions. That keeps the
generated code a few lines long however many words there are (a chain of a hundred
``contains`` calls per list outgrows what the JVM will compile), while the byte search
itself stays the compiled one. ``let`` binds the text once, so that a text that is itself
an expression is not computed again for every word.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_SEPARATOR = "\x1f"


def word_array(words: Sequence[str]) -> Column:
    """A literal array of strings. The optimizer folds the split of one literal, which
    reaches the JVM in two calls instead of one per word."""
    if not words:
        return F.array().cast("array<string>")
    return F.split(F.lit(_SEPARATOR.join(words)), _SEPARATOR)


def any_contains(text: Column, words: Sequence[str]) -> Column:
    """True when ``text`` contains at least one of ``words``; a null text contains none."""
    return let(text, lambda t: contains_any_of(t, words))


def contains_any_of(bound: Column, words: Sequence[str]) -> Column:
    """``any_contains`` for a text that is already bound or a plain column."""
    wanted = _without_covered(words)
    if not wanted:
        return F.lit(False)
    return F.coalesce(F.exists(word_array(wanted), lambda w: bound.contains(w)), F.lit(False))


def first_class(text: Column, classes: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The first class one of whose words is contained."""

    def chain(t: Column) -> Column:
        out = F
        for name, words in classes:
            out = out.when(contains_any_of(t, words), name)
        return out.otherwise(default)

    return let(text, chain)


def contained_words(text: Column, words: Sequence[str]) -> Column:
    """All contained words, in list order."""
    return let(text, lambda t: F.filter(word_array(words), lambda w: t.contains(F.lower(w))))


def _without_covered(words: Sequence[str]) -> list[str]:
    # a word that holds another listed word can never decide an "any" match on its own
    low = list(dict.fromkeys(w.lower() for w in words))
    return [w for w in low if not any(o != w and o in w for o in low)]
