"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each model sees which of its words and word beginnings (of
STEMS letters, for inflected and compound words) a text holds and, besides, the probabilities of all
categories before it. In training these are out-of-fold predictions (a model that
has not seen the row), so that later models learn how far earlier ones can be trusted; in scoring they come
from models of all training rows.

The labels know one column, ``toxic``. The categories before it are weak labels: a row is positive where it
is labelled toxic and holds a word of the category's seed list. The last link is ``toxic`` as labelled. The
seeds only name the categories; which words count for a model is learned.

Only the fit uses a sample, bounded by SAMPLE_ROWS a class and chosen by a hash of the id. Scores read every
text whole.

Defined results: a null or empty text holds no words and gets what the chain gives for none; without labels
of both classes every score is the share of toxic labels (0 if there are none); documents with contradicting
labels are not learned from; repeated rows are scored each; an empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalsieve.llm.compression_quality import fit_logistic
from signalsieve.llm.shared import written
from signalsieve.llm.words import hash_words, mixed, own_copy, slices, split

SAMPLE_ROWS = 3_000
STEMS = (4, 5, 6, 7)
WORDS = 384  # words and beginnings that a model may look at
LEAST_TEXTS = 4  # of the sample, that hold one before it counts
FOLDS = 4
RIDGE = 1.0
CUTOFF = 0.5
# words that name the weak categories
SEEDS = {
    "insult": ["idiot", "moron", "stupid", "fool", "clown", "imbecile", "dumb"],
    "contempt": ["loser", "pathetic", "worthless", "useless", "failure"],
    "disgust": ["scum", "trash", "disgusting", "filth", "vermin"],
}


@dataclass(frozen=True)
class Link:
    """One category: word hashes (ascending) with weights, weights of earlier categories, and a constant."""

    name: str
    words: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    constant: float


@dataclass(frozen=True)
class Chain:
    links: tuple[Link, ...]
    share: float


def signs(words: pa.Array) -> list[np.ndarray]:
    """Hashes of each word and of its beginnings; 0 where a word is no longer than the beginning."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    out = [hash_words(words)]
    for k in STEMS:
        stem = hash_words(pc.utf8_slice_codeunits(words, 0, k)) ^ mixed(np.full(1, k, np.uint64))
        out.append(np.where(lengths > k, stem, np.uint64(0)))
    return out


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, code) of every word, and the distinct words: runs of letters and digits in lower case."""
    texts = pc.utf8_lower(own_copy(texts))
    starts, words = split(pc.replace_substring_regex(texts, r"[^\p{L}\p{N}]+", " "), lower=False)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    if not len(words):
        return text, np.empty(0, np.int64), words
    coded = words.dictionary_encode()
    return text, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def held_signs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, sign) pairs, each once, ascending."""
    text, code, words = coded_words(texts)
    pairs = [(text, s[code]) for s in signs(words)] if len(words) else []
    text = np.concatenate([p[0] for p in pairs]) if pairs else np.empty(0, np.int64)
    found = np.concatenate([p[1] for p in pairs]) if pairs else np.empty(0, np.uint64)
    order = np.lexsort((found, text))
    text, found = text[order], found[order]
    new = found != 0
    new[1:] &= (text[1:] != text[:-1]) | (found[1:] != found[:-1])
    return text[new], found[new]


def places(asked: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Index in ``known`` (ascending) of each value, -1 where it is not there."""
    if not len(known):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[at] == asked, at, -1)


def presence(text: np.ndarray, found: np.ndarray, n: int, known: np.ndarray) -> np.ndarray:
    """0/1 matrix of texts by ``known`` signs."""
    x = np.zeros((n, len(known)))
    at = places(found, known)
    x[text[at >= 0], at[at >= 0]] = 1
    return x


def telling_words(text: np.ndarray, hashes: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The WORDS words whose share differs most between positive and negative texts, in standard errors."""
    words, inverse = np.unique(hashes, return_inverse=True)
    held = np.bincount(inverse, minlength=len(words)).astype(float)
    positive = np.bincount(inverse, weights=y[text], minlength=len(words))
    n1, n0 = max(y.sum(), 1), max(len(y) - y.sum(), 1)
    both = held / (n1 + n0)
    gap = positive / n1 - (held - positive) / n0
    strength = np.abs(gap) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / n1 + 1 / n0))
    strength[held < LEAST_TEXTS] = -1
    best = np.lexsort((words, -strength))[:WORDS]
    return np.sort(words[best[strength[best] > 0]])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights, the constant first; a constant model where one class is missing."""
    if not 0 < y.sum() < len(y):
        w = np.zeros(x.shape[1])
        w[0] = 10.0 if len(y) and y.all() else -10.0
        return w
    return fit_logistic(x, y, weight, RIDGE, 12)


def train(
    text: np.ndarray, hashes: np.ndarray, labels: Sequence[tuple[str, np.ndarray]], weight: np.ndarray,
    fold: np.ndarray, share: float,
) -> Chain:
    """A chain over (name, 0/1 per text) in the given order."""
    n = len(weight)
    outside = np.zeros((n, 0))  # out-of-fold probabilities of earlier categories
    links = []
    for name, y in labels:
        words = telling_words(text, hashes, y)
        x = np.hstack([np.ones((n, 1)), presence(text, hashes, n, words), outside])
        p = np.zeros(n)
        for k in range(FOLDS):
            rest, own = fold != k, fold == k
            p[own] = _sigmoid(x[own] @ _fit(x[rest], y[rest], weight[rest]))
        w = _fit(x, y, weight)
        links.append(Link(name, words, w[1 : 1 + len(words)], w[1 + len(words) :], float(w[0])))
        outside = np.hstack([outside, p[:, None]])
    return Chain(tuple(links), share)


def apply(chain: Chain, texts: pa.Array) -> np.ndarray:
    """Probabilities, a row a text and a column a category."""
    known = np.unique(np.concatenate([link.words for link in chain.links]))
    text, code, words = coded_words(texts)
    x = np.zeros((len(texts), len(known)))
    for own in signs(words) if len(words) else ():
        at = places(own, known)[code]
        x[text[at >= 0], at[at >= 0]] = 1
    out = np.zeros((len(texts), len(chain.links)))
    for k, link in enumerate(chain.links):
        z = x[:, np.searchsorted(known, link.words)] @ link.weights + out[:, :k] @ link.earlier + link.constant
        out[:, k] = _sigmoid(z)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Chain:
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("y_max")).where("y = y_max").select("doc_id", "y")
    )
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return Chain((), share)
    order = F.xxhash64(F.lit("toxicity"), "doc_id")
    picked = None
    for y in (0, 1):
        best = known.where(F.col("y") == y).orderBy(order, "doc_id").limit(SAMPLE_ROWS)
        picked = best if picked is None else picked.union(best)
    # at most SAMPLE_ROWS rows a class; their distinct words, not their texts, come to the driver
    sample = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                text, hashes = held_signs(rows.column("text"))
                bounds = np.searchsorted(text, np.arange(rows.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("y"),
                     pa.ListArray.from_arrays(pa.array(bounds), pa.array(hashes.view(np.int64)))],
                    names=["doc_id", "y", "words"])

    kinds = dict(sample.dtypes)
    ddl = f"doc_id {kinds['doc_id']}, y {kinds['y']}, words array<bigint>"
    rows = written(sample.mapInArrow(run, ddl), "toxicity-sample").orderBy("doc_id", "words").toArrow()
    y = rows.column("y").to_numpy().astype(float)
    lists = rows.column("words").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    text = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    hashes = lists.flatten().to_numpy().view(np.uint64)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    targets = []
    for name, seeds in SEEDS.items():
        held = presence(text, hashes, len(y), np.sort(hash_words(pa.array(seeds, pa.large_string())))).any(axis=1)
        targets.append((name, held * y))
    return train(text, hashes, [*targets, (label, y)], weight, np.arange(len(y)) % FOLDS, share)


def score(docs: DataFrame, chain: Chain, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, a probability per category (p_name), predicted. One pass, nothing shuffled."""
    names = [link.name for link in chain.links] or [*SEEDS, "toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                p = apply(chain, rows.column("text")) if chain.links else np.full((rows.num_rows, len(names)), chain.share)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(c) for c in p.T.copy())],
                                                 names=["doc_id", *(f"p_{n}" for n in names)])

    ddl = "doc_id long, " + ", ".join(f"p_{n} double" for n in names)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)
    return scored.withColumn("predicted", (F.col(f"p_{names[-1]}") >= cutoff).cast("int"))
