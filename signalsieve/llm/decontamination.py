"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, lower-cased, so that case and punctuation do not hide a copy. Every
run of SEED_WORDS words of a test item is a seed. A first pass counts the seeds over the whole corpus;
seeds that are far more frequent than their item's typical seed are common: mostly phrases, but also the
stretch of an item that many documents share. A second pass meets the seeds in the documents and aligns the
words around each meeting with the item. At a common seed it does so only if enough of the item's words
stand around it for a match, a bound that no alignment exceeds. So no seed is dropped: the counts decide
what is bounded first, not what is found. The score is the alignment's value divided by that of a full
copy (1.0). A match has a score of MIN_SCORE, or a value of RUN_WORDS intact words, whatever share of a long
item that is.

The benchmark is a query set that is held against all documents in blocks of bounded size; documents are
never shuffled, and no key can be hot. A copy is found if it keeps one seed intact and is a match by score or value.

Defined results: null or empty texts and items match nothing; items of fewer than SEED_WORDS words are not
searched; equal items each give their own match; repeated rows are judged each; an empty benchmark or
corpus gives no matches. All input columns are kept whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalsieve.llm.shared import releasing
from signalsieve.llm.words import hash_words, own_copy, slices, split

SEED_WORDS = 4
MIN_SCORE = 0.5
RUN_WORDS = 13  # an alignment worth so many words in a row is a match in an item of any length
COMMON_TIMES = 10  # a seed this many times as frequent as its item's median seed is common
BLOCK_BYTES = 8_000_000  # benchmark text held in a task at a time
MATCH, MISMATCH, GAP = 2, -1, -1
MATCHES = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
]))


def normal_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(starts, word hashes) of texts, by runs of letters and digits in lower case."""
    texts = pc.utf8_lower(own_copy(texts))
    starts, words = split(pc.replace_substring_regex(texts, r"[^\p{L}\p{N}]+", " "), lower=False)
    return starts, hash_words(words)


def runs(starts: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) per word position: of the run that begins there; index -1 where the text ends first."""
    n = len(hashes)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    if n < width:
        return np.zeros(n, np.uint64), np.full(n, -1)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out = (out ^ hashes[k : n - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    whole = text[: n - width + 1] == text[width - 1 :]
    pad = np.zeros(width - 1, np.uint64)
    return np.concatenate([out, pad]), np.concatenate([np.where(whole, text[: n - width + 1], -1), np.full(width - 1, -1)])


def align(window: np.ndarray, item: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of an item inside a window of words: (value, first, last) in the window."""
    steps = np.arange(len(window) + 1)
    value = np.zeros(len(window) + 1, np.int64)
    begin = steps.copy()  # where the alignment that ends here began
    best = (0, 0, -1)
    for word in item:
        diagonal = np.concatenate([[0], value[:-1] + np.where(window == word, MATCH, MISMATCH)])
        came = np.concatenate([[0], begin[:-1]])
        down = value + GAP
        start = np.where(diagonal >= down, came, begin)
        now = np.maximum(diagonal, down)
        start = np.where(now > 0, start, steps)
        now = np.maximum(now, 0)
        # gaps in the item: the best earlier cell less one point a step
        slope = now - GAP * steps
        top = np.maximum.accumulate(slope)
        source = np.maximum.accumulate(np.where(slope == top, steps, 0))
        value, begin = top + GAP * steps, start[source]
        at = int(value.argmax())
        if value[at] > best[0]:
            best = (int(value[at]), int(begin[at]), at - 1)
    return best


@dataclass(frozen=True)
class Block:
    """Items of one block: ids, their words, and the seeds sorted by hash with the places they come from."""

    ids: list[int | None]
    starts: np.ndarray
    words: np.ndarray
    seeds: np.ndarray  # distinct, ascending
    first: np.ndarray  # places of seed s: [first[s], first[s + 1])
    item: np.ndarray
    place: np.ndarray
    common: np.ndarray  # of the seed at this place, whether it is common for its item

    def words_of(self, item: int) -> np.ndarray:
        return self.words[self.starts[item] : self.starts[item + 1]]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of the seed per hash, -1 where there is none."""
        if not len(self.seeds):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.seeds, hashes), len(self.seeds) - 1)
        return np.where(self.seeds[at] == hashes, at, -1)


def _block(ids: list[int | None], starts: np.ndarray, words: np.ndarray, common=None) -> Block:
    hashes, item = runs(starts, words, SEED_WORDS)
    real = item >= 0
    common = (np.zeros(len(hashes), bool) if common is None else common)[real]
    place = (np.arange(len(hashes)) - starts[:-1][item])[real]
    hashes, item = hashes[real], item[real]
    order = np.argsort(hashes, kind="stable")
    seeds, first = np.unique(hashes[order], return_index=True)
    return Block(ids, starts, words, seeds, np.append(first, len(order)), item[order], place[order], common[order])


def read_block(items: DataFrame) -> Block:
    """A block of (item_id, text) of bounded size, on the driver."""
    rows = items.toArrow()
    starts, words = normal_words(rows.column("text").combine_chunks())
    return _block(rows.column("item_id").to_pylist(), starts, words)


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The benchmark in blocks of about BLOCK_BYTES of text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0]
    if total is None:
        return
    count = 1 + total // BLOCK_BYTES
    for k in range(count):
        part = F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k
        yield read_block(items.where(part).orderBy("item_id", "text"))


def ranked(docs: DataFrame, block: Block) -> Block:
    """The block with its common seeds marked, by counts over all documents."""
    if not len(block.seeds):
        return block

    @releasing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(block.seeds), np.int64)
        for batch in batches:
            for rows in slices(batch, "text"):
                starts, words = normal_words(rows.column("text"))
                hashes, text = runs(starts, words, SEED_WORDS)
                found = block.find(hashes)
                total += np.bincount(found[(found >= 0) & (text >= 0)], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["seed", "n"])

    # one row a seed at most, so no more than the block has words
    counted = docs.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
    times = np.zeros(len(block.seeds), np.int64)
    times[counted.column("seed").to_numpy()] = counted.column("n").to_numpy()
    hashes, item = runs(block.starts, block.words, SEED_WORDS)
    own = times[block.find(hashes)]
    common = np.zeros(len(hashes), bool)
    for k in range(len(block.ids)):
        here = np.flatnonzero(item[block.starts[k] : block.starts[k + 1]] == k) + block.starts[k]
        if len(here):
            common[here] = own[here] > COMMON_TIMES * float(np.median(own[here]))
    return _block(block.ids, block.starts, block.words, common)


def may_reach(window: np.ndarray, item: np.ndarray, value: float) -> bool:
    """Whether an alignment can have this value: its matches are item words that the window holds."""
    return MATCH * np.count_nonzero(np.isin(item, window)) >= value


def find_in_batch(texts: pa.Array, block: Block, min_score: float) -> list[list[dict]]:
    """Matches per text, best alignment per item, by item id."""
    starts, words = normal_words(texts)
    hashes, text = runs(starts, words, SEED_WORDS)
    found = block.find(hashes)
    hits = np.flatnonzero((found >= 0) & (text >= 0))
    out: list[list[dict]] = [[] for _ in range(len(starts) - 1)]
    met: dict[tuple[int, int], dict[int, bool]] = defaultdict(dict)
    for at in hits.tolist():
        for k in range(block.first[found[at]], block.first[found[at] + 1]):
            # where the item would begin if nothing was added or left out, and whether only common seeds say so
            begins, begin = met[int(text[at]), int(block.item[k])], at - int(block.place[k])
            begins[begin] = begins.get(begin, True) and bool(block.common[k])
    for (doc, item), begins in met.items():
        wanted = block.words_of(item)
        least = MATCH * min(min_score * len(wanted), RUN_WORDS)
        slack = 4 + len(wanted) // 2
        lo, hi = int(starts[doc]), int(starts[doc + 1])
        best, reach = (0, 0, 0), None
        for begin in sorted(begins):
            if reach is not None and begin <= reach:
                continue  # inside the window before
            a, b = max(lo, begin - slack), min(hi, begin + len(wanted) + slack + slack // 2)
            if begins[begin] and not may_reach(words[a:b], wanted, least):
                continue
            reach = begin + slack // 2
            value, first, last = align(words[a:b], wanted)
            if value > best[0]:
                best = (value, a + first - lo, a + last - lo)
                if value == MATCH * len(wanted):
                    break
        if best[0] >= least:
            score = best[0] / (MATCH * len(wanted))
            out[doc].append({"item_id": block.ids[item], "score": score, "first_word": best[1], "last_word": best[2]})
    for row in out:
        row.sort(key=lambda m: (m["item_id"] is None, m["item_id"] or 0))
    return out


def with_matches(docs: DataFrame, block: Block, min_score: float = MIN_SCORE, name: str = "_matches") -> DataFrame:
    """``docs`` and its matches with the items of a block. One pass, nothing shuffled."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, MATCHES)])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()),
                               ("last_word", pa.int64())]))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                found = pa.array(find_in_batch(rows.column("text"), block, min_score), kind)
                yield pa.RecordBatch.from_arrays([*rows.columns, found], names=[*rows.schema.names, name])

    return docs.mapInArrow(run, schema)


def matches(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word of every document and item that match."""
    out = None
    for block in blocks(benchmark):
        found = with_matches(docs.select("doc_id", "text"), ranked(docs, block), min_score)
        rows = found.select("doc_id", F.inline("_matches"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        empty = docs.select("doc_id").limit(0)
        return empty.select("doc_id", F.inline(F.array().cast(MATCHES)))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without those that match an item; counts are taken over all of ``docs``."""
    name = "_matches"
    while name in docs.columns:
        name = "_" + name
    kept = docs
    for block in blocks(benchmark):
        kept = with_matches(kept, ranked(docs, block), min_score, name).where(F.size(name) == 0).drop(name)
    return kept
