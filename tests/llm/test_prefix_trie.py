"""The prefix trie against a plain-Python trie."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from signalsieve.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, pos long, depth int, hi string, first long, level int"


def brute(rows, rebuild):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            talks[conv].append((turn is not None, turn or 0, role or "", text or ""))

    def turn_key(t):
        return t[:2], hashlib.sha256(f"{len(t[2])}:{t[2]}{t[3]}".encode()).digest()[:16]

    talks = {c: [t[2:] for t in sorted(v, key=turn_key)] for c, v in talks.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in talks}
        talks = {c: talks.get(c - c % 100, [])[: h[c]] + own[h[c] :] for c, own in talks.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    below = defaultdict(list)
    for path in members:
        if path:
            below[path[:-1]].append(path)
    out = set()
    sums = {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        sums[path] = (sum(sums[p][0] for p in below[path]) or 1, own + sum(sums[p][1] for p in below[path]))
    for path, of in members.items():
        ids = ",".join(map(str, sorted(ends[path])))
        out.add((min(of), len(path), min(members[path[:-1]]) if path else None, len(of), len(below[path]),
                 *sums[path], hashlib.sha256(ids.encode()).hexdigest()))
    return out


def rows_of(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found = [tuple(r[n] for n in names) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, "x", 1, 1) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def talks():
    """Few different turns, so that many prefixes are shared; one long conversation with a copy; one without turns left."""
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "é" * 9]))
            for c in range(90, 420) for t in range(rng.randrange(1, 7))]
    rows += [(c, t, "user", f"{t % 7}") for c in (500, 555) for t in range(61)]
    rows += [(10_007, 0, "user", "alone"), (None, 1, "user", "nobody")]
    rows += [(600, None, None, None), (600, None, None, None), (600, 3, "user", None), (600, 3, None, "user"), (600, 3, None, "user")]
    return rows


@pytest.mark.parametrize("width", [1, 3, 8])
@pytest.mark.parametrize("rebuild", [False, True])
def test_trie(spark, talks, width, rebuild):
    of = prefix_trie.rebuilt_trie if rebuild else prefix_trie.prefix_trie
    assert rows_of(of(table(spark, talks), width)) == brute(talks, rebuild)


def test_many_copies_in_one_node(spark, monkeypatch):
    """A third of all conversations is the same; its list of ids comes from many pieces."""
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 7)
    rows = [(c, t, "user", "same") for c in range(0, 3_000, 3) for t in range(2)]
    rows += [(c, 0, "user", f"own {c}") for c in range(3_000) if c % 3]
    assert rows_of(prefix_trie.prefix_trie(table(spark, rows))) == brute(rows, False)


def test_no_conversations(spark):
    assert prefix_trie.rebuilt_trie(table(spark, [])).count() == 0
