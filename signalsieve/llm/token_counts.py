"""Token counts of documents through a cache of digests.

The cache is a table of (tokenizer, digest, n_tokens), partitioned by tokenizer: the SHA-256 of library, its
version and the vocabulary file; ``digest`` is the SHA-256 of a text's normalised content. A run digests
all texts, looks the digests up, encodes one text for each digest that is missing, appends these counts to the
cache, and reads all counts from there. A text that was ever counted with a tokenizer is not encoded again;
copies are encoded once; another tokenizer, or another version of its library, finds nothing of the first's.

Normalised content is the text with null as empty. A further normal form may be given where it cannot change
a count. Whole texts are shuffled only if they are missing, one of each digest in a task; the rest are digests.
A digest of a thousandth of all rows or more meets its count by broadcast, the other ones in a join.

Where the vocabulary allows (byte-level pairs, no normaliser, no special token with white space), texts are cut at
single spaces and line ends between visible characters, where the tokenizer cuts as well, and each distinct
piece is encoded once a task; otherwise whole texts are encoded.

Defined results: null and empty texts have no bytes and no tokens; null ids and repeated rows are all returned;
an empty table gives no rows and leaves the cache as it is; a digest that two runs appended at once counts once.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalsieve.llm.shared import rows_per_batch, written
from signalsieve.llm.words import own_copy, slices

CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"
BATCH_ROWS = 1_000
CACHED_PIECES = 60_000  # counted pieces that a task keeps, the first it meets
CACHED_LENGTH = 32
HEAVY_SHARE = 1_000  # a digest of more than this part of all rows is broadcast: fewer than so many rows
FEW_DIGESTS = 100_000  # so many missing digests (3 MB) are broadcast to pick the texts to encode
CUT = "\x1e"  # stands at cuts; a text that holds it is encoded whole
VISIBLE = r"[!-~\p{L}\p{N}]"


def _json_library() -> str:
    import tokenizers

    return f"tokenizers {tokenizers.__version__}"


def _model_library() -> str:
    import sentencepiece

    return f"sentencepiece {sentencepiece.__version__}"


def _read(vocabulary_file: str) -> tuple[str, bytes]:
    """(library and version, content) of a vocabulary file: a few MB whatever the corpus."""
    library = _model_library() if vocabulary_file.endswith(".model") else _json_library()
    with open(vocabulary_file, "rb") as f:
        return library, f.read()


def tokenizer_version(vocabulary_file: str) -> str:
    """SHA-256 of library, version and vocabulary."""
    library, content = _read(vocabulary_file)
    return hashlib.sha256(library.encode() + b"\0" + content).hexdigest()


def _cuttable(vocabulary: bytes) -> bool:
    """Whether texts may be cut at single white space between visible characters."""
    found = json.loads(vocabulary)
    before = found.get("pre_tokenizer") or {}
    return (
        found.get("normalizer") is None and before.get("type") == "ByteLevel"
        and before.get("use_regex", True) and not before.get("add_prefix_space")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])
                    for t in found.get("added_tokens", []))
    )


class Counter:
    """Counts tokens of texts with one vocabulary."""

    def __init__(self, library: str, vocabulary: bytes):
        if library.startswith("sentencepiece"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=vocabulary)
            self.whole: Callable[[list[str]], list[int]] = lambda texts: list(map(len, model.encode(texts, num_threads=1)))
            self.cuts = False
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_str(vocabulary.decode())
        model.no_truncation()
        model.no_padding()
        self.whole = lambda texts: [len(e.ids) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
        self.cuts = _cuttable(vocabulary)
        self.known: dict[str, int] = {}

    def _pieces(self, pieces: list[str]) -> list[int]:
        found = list(map(self.known.get, pieces))
        missing = [i for i, n in enumerate(found) if n is None]
        for i, n in zip(missing, self.whole([pieces[i] for i in missing])):
            found[i] = n
            if len(self.known) < CACHED_PIECES and len(pieces[i]) <= CACHED_LENGTH:
                self.known[pieces[i]] = n
        return found

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; nulls are empty."""
        texts = own_copy(texts)
        if not self.cuts:
            return np.array(self.whole(texts.to_pylist()), np.int64)
        marked = pc.replace_substring_regex(texts, f"({VISIBLE}) ({VISIBLE})", rf"\1{CUT} \2")
        marked = pc.replace_substring_regex(marked, f"({VISIBLE}\n)({VISIBLE})", rf"\1{CUT}\2")
        lists = pc.split_pattern(marked, CUT)
        coded = lists.flatten().dictionary_encode()
        sizes = np.array(self._pieces(coded.dictionary.to_pylist()), np.int64)[coded.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        counts = np.diff(ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()])
        own = np.flatnonzero(pc.match_substring(texts, CUT).to_numpy(zero_copy_only=False))
        if len(own):
            counts[own] = self.whole(texts.take(pa.array(own)).to_pylist())
        return counts


@lru_cache(maxsize=1)
def _counter(library: str, vocabulary: bytes) -> Counter:
    return Counter(library, vocabulary)


def _encode(texts: DataFrame, vocabulary_file: str) -> DataFrame:
    """digest, n_tokens of rows (digest, text)."""
    library, vocabulary = _read(vocabulary_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(library, vocabulary)
        for batch in batches:
            for rows in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [rows.column("digest"), pa.array(counter.count(rows.column("text")))], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def cached_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """digest, n_tokens of one tokenizer; none where the cache does not exist yet."""
    try:
        found = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], CACHE_SCHEMA)
    # appended twice by runs at the same time: equal rows
    return found.where(F.col("tokenizer") == version).select("digest", "n_tokens").dropDuplicates(["digest"])


def _missing_texts(docs: DataFrame, digest: Column, content: Column, missing: DataFrame, n_missing: int) -> DataFrame:
    """digest, text: one text of each missing digest."""
    texts = docs.select(digest.alias("digest"), content.alias("text"))
    few = n_missing <= FEW_DIGESTS
    if few:
        texts = texts.join(F.broadcast(missing), "digest", "left_semi")
    # copies are dropped in the tasks that read them, and again behind the shuffle
    first = Window.partitionBy("digest").orderBy("digest")
    texts = texts.withColumn("_copy", F.row_number().over(first)).where("_copy = 1").drop("_copy")
    return texts if few else texts.join(missing, "digest", "left_semi")


def _with_counts(keys: DataFrame, counts: DataFrame) -> DataFrame:
    """``keys`` with the count of their digest, where one digest may hold any part of the rows."""
    copies = keys.groupBy("digest").count()
    heavy = copies.where(F.col("count") * HEAVY_SHARE > keys.count()).select("digest")  # fewer than HEAVY_SHARE rows
    heavy = written(heavy.join(counts, "digest"), "heavy-digests")
    often = keys.join(F.broadcast(heavy), "digest")
    rest = keys.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(counts, "digest", "left")
    return often.unionByName(rest)


def count_tokens(docs: DataFrame, cache: str, vocabulary_file: str,
                 normal: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens of ``docs`` (doc_id, text). Appends to the cache table at ``cache`` what it lacks.

    ``normal`` gives a text's normalised content (a Column of it), where that has the same tokens."""
    spark, version = docs.sparkSession, tokenizer_version(vocabulary_file)
    text = F.coalesce(F.col("text"), F.lit(""))
    content = normal(text) if normal else text
    digest = F.unhex(F.sha2(content, 256))
    keys = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                               digest.alias("digest")), "content-digests")
    known = cached_counts(spark, cache, version)
    missing = written(keys.select("digest").distinct().join(known.select("digest"), "digest", "left_anti"), "missing-digests")
    n_missing = missing.count()
    if n_missing:
        texts = _missing_texts(docs, digest, content, missing, n_missing)
        with rows_per_batch(spark, BATCH_ROWS):
            (_encode(texts, vocabulary_file).withColumn("tokenizer", F.lit(version))
             .write.mode("append").partitionBy("tokenizer").parquet(cache))
    return _with_counts(keys, cached_counts(spark, cache, version)).select("doc_id", "n_bytes", "n_tokens")
