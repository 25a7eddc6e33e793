"""Many keywords in one pass over a text.

All keywords of a rule set become one regular expression in the shape of their common
prefixes, wrapped in a look-ahead so that overlapping hits are seen. ``hits`` scans a text
once and gives the longest keyword at each place, without repeats; a keyword is contained
exactly when it starts one of the hits. Every rule is then a small set test. Scanning once
per word instead costs over ten times as much with a few hundred words.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalsieve.functions.matching import let, word_array

# measured best on mixed prose; one group per letter is four times slower
_FIRST_CHARS_PER_GROUP = 8
_CHECKED_CHARS = 3


def _pattern(words: Iterable[str]) -> str:
    """Regular expression for the longest of ``words`` at a place.

    Words are grouped by first letter. Each group is guarded by the classes of its first
    three characters, so that almost every place of a text fails after a few cheap tests.
    """
    words = sorted(words)
    firsts = sorted({w[0] for w in words})
    parts = []
    for i in range(0, len(firsts), _FIRST_CHARS_PER_GROUP):
        group = [w for w in words if w[0] in firsts[i : i + _FIRST_CHARS_PER_GROUP]]
        depth = min(_CHECKED_CHARS, min(map(len, group)))
        guard = "".join(f"[{''.join(map(_in_class, sorted({w[d] for w in group})))}]" for d in range(depth))
        parts.append(f"(?={guard}){_render(_tree(group))}")
    return "(?=(" + "|".join(parts) + "))"


def _tree(words: Iterable[str]) -> dict:
    root: dict = {}
    for word in words:
        node = root
        for char in word:
            node = node.setdefault(char, {})
        node[""] = {}
    return root


def _render(node: dict) -> str:
    """Common prefixes factored out; a longer word is tried before a shorter one."""
    ways = [_literal(char) + _render(child) for char, child in sorted(node.items()) if char]
    if not ways:
        return ""
    body = ways[0] if len(ways) == 1 and "" not in node else "(?:" + "|".join(ways) + ")"
    return body + "?" if "" in node else body


def _literal(char: str) -> str:
    return "\\" + char if char in r"\^$.|?*+()[]{}#&-" else char


def _in_class(char: str) -> str:
    return "\\" + char if char in r"\^-[]&" else char


class KeywordIndex:
    """A fixed set of keywords and the tests on its hits."""

    def __init__(self, *word_lists: Iterable[str]):
        self.words = sorted({w.lower() for words in word_lists for w in words if w})
        self.pattern = _pattern(self.words) if self.words else None
        self._starts: dict[str, list[str]] = {}
        for key in self.words:
            for end in range(1, len(key) + 1):
                self._starts.setdefault(key[:end], []).append(key)

    def hits(self, lowered: Column) -> Column:
        """Longest keyword at each place of a lower-cased text, distinct."""
        if self.pattern is None:
            return F.array().cast("array<string>")
        return F.array_distinct(F.regexp_extract_all(lowered, F.lit(self.pattern), F.lit(1)))

    def _started_by(self, words: Iterable[str]) -> list[str]:
        return sorted({k for w in words for k in self._starts.get(w.lower(), ())})

    def any(self, hits: Column, words: Sequence[str]) -> Column:
        """At least one of ``words`` is contained."""
        closing = self._started_by(words)
        return F.arrays_overlap(hits, word_array(closing)) if closing else F.lit(False)

    def first(self, hits: Column, pairs: Sequence[tuple[str, str]]) -> Column:
        """The value of the first contained word in list order; null when none is."""
        best: dict[str, int] = {}
        for place in range(len(pairs) - 1, -1, -1):
            for key in self._started_by([pairs[place][0]]):
                best[key] = place
        if not best:
            return F.lit(None).cast("string")
        # all keys and their places as two literals; the place is looked up by position
        keys = word_array(list(best))
        places = word_array([str(p) for p in best.values()]).cast("array<int>")
        values = word_array([value for _, value in pairs])
        place = F.array_min(
            F.transform(hits, lambda h: F.get(places, (F.array_position(keys, h) - 1).cast("int")))
        )
        return let(place, lambda p: F.get(values, p))

    def groups(self, hits: Column, named: dict[str, Sequence[str]]) -> Column:
        """Names of the groups with a contained word, sorted."""
        tests = [F.when(self.any(hits, words), name) for name, words in sorted(named.items())]
        return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
