"""Words of whole texts as arrays, for Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 2_000_000  # text that is taken apart at a time; one text may be longer


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of text, or of one longer text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for row, size in enumerate(sizes):
        if total and total + size > limit:
            yield batch.slice(first, row - first)
            first, total = row, 0
        total += int(size)
    if batch.num_rows > first:
        yield batch.slice(first)


def own_copy(texts: pa.Array) -> pa.Array:
    """Large strings without nulls whose data begin at 0 (string kernels misread slices of large strings)."""
    return pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))


def split(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array]:
    """(starts, words): text i has words[starts[i]:starts[i + 1]]. Words are runs of anything but ASCII
    white space; ``lower`` lower-cases A-Z only. Null texts have no words."""
    texts = own_copy(texts)
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    values = lists.flatten()
    real = pc.greater(pc.binary_length(values), 0)
    ends = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return ends[bounds].astype(np.int64), values.filter(real)


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash per word, computed once per distinct word."""
    if not len(words):
        return np.empty(0, np.uint64)
    coded = words.dictionary_encode()
    distinct = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    own = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
    return own[coded.indices.to_numpy()]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(starts: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of all runs of ``width`` words; a shorter text with words gives one run of them all.

    Order and repeats are kept. A short run is hashed with its length, so that it equals no longer one.
    """
    lengths = np.diff(starts)
    counts = np.where(lengths >= width, lengths - width + 1, (lengths > 0).astype(np.int64))
    out_starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    doc = np.repeat(np.arange(len(lengths)), counts)
    place = starts[:-1][doc] + (np.arange(out_starts[-1]) - out_starts[:-1][doc])
    out = np.zeros(len(doc), np.uint64)
    held = np.minimum(lengths[doc], width)
    last = max(len(hashes) - 1, 0)
    for k in range(width):
        step = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[np.minimum(place + k, last)]) if len(hashes) else out
        out = np.where(held > k, step, out)
    return out_starts, mixed(out + held.astype(np.uint64))
