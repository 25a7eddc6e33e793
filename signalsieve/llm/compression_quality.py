"""Quality by compression: texts like the good examples compress better with the good dictionary.

Two zstandard dictionaries are built from good and from bad labelled text. Every whole text is compressed
with both, in blocks of BLOCK_BYTES, so that the dictionary matters to its end. The normalised difference of
the sizes, next to the size per byte (text that repeats itself compresses well with either), goes through a
logistic calibration fitted on other labelled texts and weighted to the labels' true shares.

Only the fit uses a sample, bounded by DICTIONARY_ROWS and CALIBRATION_ROWS a class, chosen by a hash of the
id. A dictionary is built from at most DICTIONARY_BLOCKS blocks of DICTIONARY_BLOCK_CHARS characters, in turns one
of each of its texts, from anywhere in them. The scores read every text whole and nothing else.

Defined results: a null or empty text gets the share of good labels as its score; without labels of both
classes, so does every text; documents with contradicting labels are not learned from; a null id is never
held out; repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalsieve.llm.shared import written

DICTIONARY_ROWS = 500
CALIBRATION_ROWS = 2_000
DICTIONARY_BLOCKS = 2_000
DICTIONARY_BLOCK_CHARS = 2_048
DICTIONARY_BYTES = 64 << 10
BLOCK_BYTES = 2_048
LEVEL = 3
FOLDS = 5
CUTOFF = 0.3


@dataclass(frozen=True)
class Model:
    """Dictionaries (raw bytes), scaling and weights; without dictionaries every score is ``share``."""

    share: float
    good: bytes = b""
    bad: bytes = b""
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()


def held_out(doc_id: Column) -> Column:
    """One fold of FOLDS by the id's text; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def build_dictionary(texts: Sequence[str]) -> bytes:
    """A trained dictionary; for too few texts to train on, their own bytes."""
    data = [t.encode() for t in texts if t]
    try:
        return zs.train_dictionary(DICTIONARY_BYTES, data).as_bytes()
    except zs.ZstdError:
        return b"\n".join(data)[-DICTIONARY_BYTES:]


@lru_cache(maxsize=4)
def _compressors(good: bytes, bad: bytes):
    def make(data: bytes):
        used = {"dict_data": zs.ZstdCompressionDict(data)} if len(data) >= 8 else {}
        return zs.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False, **used)

    return make(good), make(bad)


def sizes(text: str | None, good: bytes, bad: bytes) -> tuple[int, int, int]:
    """(bytes, compressed with the good, with the bad dictionary) of a whole text."""
    data = (text or "").encode()
    total = [0, 0]
    for at in range(0, len(data), BLOCK_BYTES):
        block = data[at : at + BLOCK_BYTES]
        for k, c in enumerate(_compressors(good, bad)):
            total[k] += len(c.compress(block))
    return len(data), total[0], total[1]


def features(measured: np.ndarray) -> np.ndarray:
    """Rows of (bytes, good, bad) as (1, normalised difference, size a byte, the same up to 0.3)."""
    n, good, bad = measured.astype(float).T
    difference = (bad - good) / np.maximum(bad + good, 1)
    rate = np.minimum(np.minimum(good, bad) / np.maximum(n, 1), 1.0)
    return np.column_stack([np.ones(len(n)), difference, rate, np.minimum(rate, 0.3)])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, turns: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(curve, slope)
    return w


def _measured(rows: DataFrame, good: bytes, bad: bytes, keep: Sequence[str]) -> DataFrame:
    kept = [f for f in rows.schema.fields if f.name in keep]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sizes(t.as_py(), good, bad) for t in batch.column("text")]
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, *(pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], [], [])))],
                names=[*(f.name for f in kept), "n", "g", "b"])

    return rows.mapInArrow(run, f"{ddl}, n long, g long, b long")


def _blocks(rows: DataFrame) -> DataFrame:
    """(y, block, turn, place) of the DICTIONARY_BLOCK_CHARS blocks of whole texts; ``place`` is a hash of text and
    block, ``turn`` the rank of a block by it among those of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, o, text in zip(*(batch.column(c) for c in ("y", "o", "text"))):
                whole = text.as_py() or ""
                cuts = range(0, len(whole), DICTIONARY_BLOCK_CHARS)
                places = [xxhash.xxh64_intdigest(f"{o.as_py()} {at}") >> 1 for at in cuts]
                ordered = sorted(zip(places, cuts))[:DICTIONARY_BLOCKS]  # more of one text can never be taken
                yield pa.RecordBatch.from_arrays(
                    [pa.array([y.as_py()] * len(ordered), pa.int32()),
                     pa.array([whole[at : at + DICTIONARY_BLOCK_CHARS] for _, at in ordered], pa.string()),
                     pa.array(range(len(ordered)), pa.int64()), pa.array([p for p, _ in ordered], pa.int64())],
                    names=["y", "block", "turn", "place"])

    return rows.select(F.col("y").cast("int").alias("y"), "o", "text").mapInArrow(
        run, "y int, block string, turn long, place long")


def _material(rows: DataFrame, y: int) -> list[str]:
    """The blocks that the dictionary of a class is built from, best last."""
    best = _blocks(rows.where(F.col("y") == y)).orderBy("turn", "place", "block").limit(DICTIONARY_BLOCKS)
    return [r.block for r in best.collect()][::-1]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Learns from labelled documents outside the held-out fold."""
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("y_max")).where("y = y_max").select("doc_id", "y")
    )
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    if len(counts) < 2:
        return Model(share)
    order = F.xxhash64(F.lit("sample"), "doc_id")
    wanted = DICTIONARY_ROWS + CALIBRATION_ROWS
    picked = None
    for y in (0, 1):
        best = known.where(F.col("y") == y).orderBy(order, "doc_id").limit(wanted)
        picked = best if picked is None else picked.union(best)
    # at most wanted rows a class
    sample = written(
        docs.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y", order.alias("o")), "quality-sample")
    # of each class, every fifth row or so builds the dictionary and the others calibrate
    fraction = DICTIONARY_ROWS / wanted
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(1000)) < int(1000 * fraction)
    good, bad = (build_dictionary(_material(sample.where(part), y)) for y in (1, 0))
    rows = _measured(sample.where(~part), good, bad, ("y",)).orderBy("y", "n", "g", "b").toArrow()
    y = rows.column("y").to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return Model(share)
    x = features(np.column_stack([rows.column(c).to_numpy() for c in ("n", "g", "b")]))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    mean[0], scale[0] = 0.0, 1.0
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    w = fit_logistic((x - mean) / scale, y, weight)
    return Model(share, good, bad, tuple(mean), tuple(scale), tuple(w))


def scores(measured: np.ndarray, model: Model) -> np.ndarray:
    if not model.weights:
        return np.full(len(measured), model.share)
    z = (features(measured) - np.array(model.mean)) / np.array(model.scale) @ np.array(model.weights)
    return np.where(measured[:, 0] == 0, model.share, 1 / (1 + np.exp(-np.clip(z, -30, 30))))


def score(docs: DataFrame, model: Model, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. One pass, nothing shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([sizes(t.as_py(), model.good, model.bad) for t in batch.column("text")]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(found, model))],
                                             names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= cutoff).cast("int").alias("predicted"))
