"""Licence texts in documents: MinHash over overlapping windows, then exact containment.

Words are runs of letters and digits, lower-cased; shingles are SHINGLE words. Templates are sorted into
classes by their number of shingles, class c up to 2^c of them. A document is cut into blocks of 2^c
shingles, and two neighbouring blocks are a window, so that a text of the class lies in one window whole.
A window that holds CONTAINED of a template's shingles has a Jaccard similarity of at least

    j = need / (2 * 2^c + S - need),      need = ceil(CONTAINED * S)

with its S shingles. Bands of one row collide with probability 1 - (1 - j)^bands; each template takes as
many bands as its j needs to miss less than MISS of such windows. Every window that collides is compared
with the template exactly: the share of the template's distinct shingles it holds.

The templates are a query set held against all documents; nothing is shuffled. Hash minima of blocks are
built from those of half blocks, so all classes together cost little more than one pass over the shingles.

Defined results: null or empty texts hold nothing; templates of fewer than SHINGLE words are not searched;
of several places of a template the first of the best is given, and a place that a template of higher
containment covers is left out (versions of a licence differ in a word); templates of one id and several wordings
give a row for each wording; repeated rows are scanned each; an empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalsieve.llm.decontamination import normal_words
from signalsieve.llm.license_texts import TEMPLATES
from signalsieve.llm.words import mixed, slices

SHINGLE = 5
CONTAINED = 0.8
MISS = 1e-4
OUT = "doc_id long, template_no int, license string, containment double, first_word long, last_word long"


def shingle_hashes(starts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of all runs of SHINGLE words; shorter texts have none."""
    counts = np.maximum(np.diff(starts) - SHINGLE + 1, 0)
    out_starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    place = starts[:-1][text] + np.arange(out_starts[-1]) - out_starts[:-1][text]
    out = np.zeros(len(place), np.uint64)
    for k in range(SHINGLE):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[place + k])
    return out_starts, out


def multiplier(band: int) -> np.uint64:
    """The odd factor that orders shingles in a band."""
    return mixed(np.array([2 * band + 1], np.uint64))[0] | np.uint64(1)


@dataclass(frozen=True)
class Template:
    no: int
    license: str
    shingles: np.ndarray  # distinct, ascending
    words: int
    size_class: int
    bands: int

    @property
    def need(self) -> int:
        return math.ceil(CONTAINED * len(self.shingles) - 1e-9)


def prepare(templates: Sequence[tuple[str, str]]) -> list[Template]:
    starts, words = normal_words(pa.array([t for _, t in templates], pa.string()))
    starts_s, hashes = shingle_hashes(starts, words)
    out = []
    for no, (name, _) in enumerate(templates):
        own = np.unique(hashes[starts_s[no] : starts_s[no + 1]])
        if not len(own):
            continue
        run = int(starts_s[no + 1] - starts_s[no])
        size_class = max(0, math.ceil(math.log2(run)))
        need = math.ceil(CONTAINED * len(own) - 1e-9)
        window = 1 if size_class == 0 else 2 << size_class  # one shingle is a block of its own
        j = need / (window + len(own) - need)
        bands = 1 if j >= 1 else math.ceil(math.log(MISS) / math.log(1 - j))
        out.append(Template(no, name, own, int(starts[no + 1] - starts[no]), size_class, bands))
    return out


def _halves(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(minima of pairs of neighbours within each text, starts): an odd last one stays alone."""
    counts = np.diff(starts)
    up = np.concatenate([[0], np.cumsum(-(-counts // 2))]).astype(np.int64)
    if not len(values):
        return values, up
    text = np.repeat(np.arange(len(counts)), np.diff(up))
    first = starts[:-1][text] + 2 * (np.arange(up[-1]) - up[:-1][text])
    second = np.minimum(first + 1, starts[1:][text] - 1)
    return np.minimum(values[first], values[second]), up


def candidates(starts: np.ndarray, hashes: np.ndarray, templates: Sequence[Template]) -> set[tuple[int, int, int]]:
    """(text, template index, first shingle of the window in the text) of all collisions."""
    found: set[tuple[int, int, int]] = set()
    top = max(t.size_class for t in templates)
    for band in range(max(t.bands for t in templates)):
        factor = multiplier(band)
        wanted: dict[int, list[int]] = defaultdict(list)
        for k, t in enumerate(templates):
            if band < t.bands:
                wanted[t.size_class].append(k)
        values, at = hashes * factor, starts
        for c in range(top + 1):
            if c:
                values, at = _halves(values, at)
            if c not in wanted or not len(values):
                continue
            text = np.repeat(np.arange(len(at) - 1), np.diff(at))
            windows = values
            if c:  # with the next block of the same text
                following = np.minimum(np.arange(len(values)) + 1, at[1:][text] - 1)
                windows = np.minimum(values, values[following])
            targets = np.array([(templates[k].shingles * factor).min() for k in wanted[c]], np.uint64)
            order = np.argsort(targets, kind="stable")
            ranked = targets[order]
            lo = np.searchsorted(ranked, windows)
            hits = np.flatnonzero(ranked[np.minimum(lo, len(ranked) - 1)] == windows)
            for i in hits.tolist():
                for r in range(lo[i], len(ranked)):
                    if ranked[r] != windows[i]:
                        break
                    found.add((int(text[i]), wanted[c][order[r]], int(i - at[text[i]]) << c))
    return found


def scan_batch(texts: pa.Array, templates: Sequence[Template]) -> list[tuple[int, Template, float, int, int]]:
    """(text, template, containment, first word, last word) of all that reach CONTAINED."""
    starts, hashes = shingle_hashes(*normal_words(texts))
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for text, k, first in sorted(candidates(starts, hashes, templates)):
        t = templates[k]
        lo = int(starts[text]) + first
        hi = min(int(starts[text + 1]), lo + (2 << t.size_class))
        window = hashes[lo:hi]
        at = np.minimum(np.searchsorted(t.shingles, window), len(t.shingles) - 1)
        held = np.flatnonzero(t.shingles[at] == window)
        share = len(np.unique(window[held])) / len(t.shingles)
        if share < t.need / len(t.shingles) or share <= best.get((text, k), (0.0,))[0]:
            continue
        begin = first + int(held[0])
        best[text, k] = (share, begin, first + int(held[-1]) + SHINGLE - 1)
    return _outdone_left_out([(text, templates[k], *b) for (text, k), b in sorted(best.items())])


def _outdone_left_out(found: list[tuple]) -> list[tuple]:
    """Without those whose place (four fifths of it or more) a template with a higher containment covers."""
    by_text: dict[int, list[tuple]] = defaultdict(list)
    for row in found:
        by_text[row[0]].append(row)

    def outdone(row: tuple) -> bool:
        _, _, share, first, last = row
        return any(
            other[2] > share and min(last, other[4]) - max(first, other[3]) + 1 >= 0.8 * (last - first + 1)
            for other in by_text[row[0]]
        )

    return [row for row in found if not outdone(row)]


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, template_no, license, containment, first_word, last_word: a row per document and template found."""
    ready = prepare(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                found = scan_batch(rows.column("text"), ready) if ready else []
                ids = rows.column("doc_id")
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([f[0] for f in found], pa.int64())),
                     pa.array([f[1].no for f in found], pa.int32()), pa.array([f[1].license for f in found], pa.string()),
                     *(pa.array([f[k] for f in found], t) for k, t in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64())))],
                    names=["doc_id", "template_no", "license", "containment", "first_word", "last_word"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)
