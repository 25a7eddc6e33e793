"""Token ids of documents in ORC files: run-length coded integers, row indexes and Bloom filters.

``encode`` range-partitions documents by id, encodes whole texts and writes one ORC file a partition, so
that file order and row order follow the ids. ORC codes the id lists with its integer run-length
encoding; readers split files by stripe and skip stripes by the min/max and Bloom filter of ``doc_id``.
``read_back`` gives every document's place in the whole sequence, ``documents_by_id`` single ones.

Defined results: a null or empty text is the end id alone; null ids come first; rows with equal ids are
all kept, in the order of a hash of their text; an empty table gives no rows. Other input columns are
not written.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalsieve.llm.shared import releasing, rows_per_batch
from signalsieve.llm.words import own_copy, slices, split

END_ID = 2
FILE_SCHEMA = "doc_id long, part int, first_token long, n_tokens long, ids array<int>"
TEXT_BYTES = 2_000_000  # text encoded at a time; one text may be longer
CACHED_WORDS = 120_000  # encoded words a worker keeps, the first it meets
CACHED_LENGTH = 32
JOINED_WORDS = 500
BATCH_ROWS = 500
MARK = r"[!-&(-/:-@\[-`{-~]"  # ASCII punctuation but the apostrophe, which contractions need
# signs that may join punctuation in one piece: controls, marks, and a letter that lower-cases to a mark
OTHER = r"(?:['\x00-\x08\x0e-\x1f\x7fİ]|[^\x00-\x7f\p{L}\p{N}])"
PLAIN = r"^[a-zß-öø-ÿ]+$"  # lower-case letters that no normalisation changes


class Encoder:
    """Encodes words with a word-end vocabulary; kept by a worker process between tasks."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.cache: dict[str, bytes] = {}
        ids = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(ids.values()) + 1, bool)
        self.closes[[i for w, i in ids.items() if w.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)  # ids without offsets

    def _joined(self, words: list[str]) -> list[bytes]:
        """Ids of plain words, many in one call: each word ends at its only word-end id."""
        ids = np.array(self._encode([" ".join(words)])[0].ids, np.int32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words):
            return self._apart(words)
        data, cuts = ids.tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]

    def _apart(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.int32).tobytes()
                for e in self._encode(words)]

    def pieces(self, words: pa.Array) -> list[bytes]:
        """Ids of each word, as 32-bit integers."""
        names = words.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.cache.get, names))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            plain = pc.match_substring_regex(words.take(pa.array(missing)), PLAIN).to_numpy(zero_copy_only=False)
            easy = [i for i, p in zip(missing, plain) if p]
            hard = [i for i, p in zip(missing, plain) if not p]
            groups = [(easy[k : k + JOINED_WORDS], self._joined) for k in range(0, len(easy), JOINED_WORDS)]
            for at, encode in [*groups, (hard, self._apart)]:
                for i, ids in zip(at, encode([names[i] for i in at])):
                    found[i] = ids
                    if len(self.cache) < CACHED_WORDS and len(names[i]) <= CACHED_LENGTH:
                        self.cache[names[i]] = ids
        return found


@lru_cache(maxsize=1)
def _encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def encode_texts(texts: pa.Array, vocabulary: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ids) of whole texts, each closed by ``end_id``.

    The vocabulary must lower-case, split at white space and between letters and punctuation, and drop
    the white space, as word-end vocabularies do. Then a text's ids are those of its pieces, and every
    distinct piece is encoded once. Pieces are cut where the tokenizer cuts as well: a text in which
    punctuation touches an apostrophe or other signs is cut at white space only, and one with the
    beginning of a special token keeps its capitals, too.
    """
    texts = own_copy(texts)
    lowered = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
    entangled = pc.match_substring_regex(texts, rf"{MARK}{OTHER}|{OTHER}{MARK}|<\|")
    loose = pc.if_else(entangled, lowered, pc.replace_substring_regex(lowered, f"({MARK}+)", r" \1 "))
    starts, words = split(loose, lower=False)
    codes, pieces = np.empty(0, np.int64), []
    if len(words):
        coded = words.dictionary_encode()
        codes, pieces = coded.indices.to_numpy().astype(np.int64), _encoder(vocabulary).pieces(coded.dictionary)
    codes = np.insert(codes, starts[1:], len(pieces))  # the end id behind each text
    pieces.append(np.int32(end_id).tobytes())
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) >> 2
    flat = np.frombuffer(b"".join(pieces), np.int32)
    first = np.cumsum(sizes) - sizes
    length = sizes[codes]
    ends = np.cumsum(length)
    ids = flat[np.repeat(first[codes] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
    bounds = np.concatenate([[0], ends])[starts + np.arange(len(starts))]
    return bounds, ids


def encode(df: DataFrame, path: str, vocabulary_file: str, end_id: int = END_ID) -> None:
    """Writes FILE_SCHEMA rows below ``path``, ascending in ``doc_id`` over all files."""
    with open(vocabulary_file, encoding="utf-8") as f:
        vocabulary = f.read()  # a vocabulary file: a few MB whatever the corpus

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch, "text", TEXT_BYTES):
                starts, ids = encode_texts(rows.column("text"), vocabulary, end_id)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"),
                        pa.array(np.full(rows.num_rows, part, np.int32)),
                        pa.array(done + starts[:-1]),
                        pa.array(np.diff(starts)),
                        pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids)),
                    ],
                    names=["doc_id", "part", "first_token", "n_tokens", "ids"],
                )
                done += len(ids)

    tie = F.xxhash64("text")
    ordered = (
        df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(F.col("doc_id"), tie)
        .sortWithinPartitions(F.col("doc_id"), tie)
    )
    with rows_per_batch(df.sparkSession, BATCH_ROWS):
        (
            ordered.mapInArrow(run, FILE_SCHEMA)
            .write.option("compression", "zstd")
            .option("orc.bloom.filter.columns", "doc_id")
            .option("orc.bloom.filter.fpp", "0.01")
            .option("orc.row.index.stride", "1000")
            .option("orc.stripe.size", str(8 << 20))
            .orc(path)
        )


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).orc(path)


def documents_by_id(spark: SparkSession, path: str, ids: Sequence[int]) -> DataFrame:
    """The documents of a few ids; stripes that cannot hold them are skipped by their metadata."""
    return stored(spark, path).where(F.col("doc_id").isin(list(ids)))


@releasing
def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        at = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), batch.column("first_token"),
             pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "part", "first_token", "n_tokens", "ids_crc32"],
        )


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the files.

    Only one row a file is ordered in one place; each document's start is that of its file plus its own
    place in the file.
    """
    rows = stored(spark, path)
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("_size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    digests = rows.mapInArrow(_digest, "doc_id long, part int, first_token long, n_tokens long, ids_crc32 long")
    # one row a file: files are as few as shuffle partitions
    return digests.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("_before") + F.col("first_token")).alias("start"), "n_tokens", "ids_crc32"
    )
