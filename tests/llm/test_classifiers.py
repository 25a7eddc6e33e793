"""Classifiers: accuracy on rows they have not learned from, and odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signalsieve.llm import compression_quality, queries, toxicity_chain

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_on_held_out_labels(spark, labels):
    rows = queries.op6_compression_quality(spark, SF).join(labels, "doc_id", "left").collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in rows if r.held_out and r.quality is not None]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.93


def test_quality_learns_from_no_held_out_label(spark, labels):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    flipped = labels.withColumn("quality", F.when(compression_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert compression_quality.fit(docs, labels) == compression_quality.fit(docs, flipped)


def test_quality_on_odd_rows(spark, odd_docs, no_docs, labels):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = compression_quality.fit(docs, labels)
    got = compression_quality.score(odd_docs, model).collect()
    assert len(got) == 14 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (4, 5)} == {model.share}
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert compression_quality.score(no_docs, model).count() == 0
    # no labels, labels of one class, contradicting labels
    assert compression_quality.fit(docs, labels.limit(0)).share == 0.5
    one = compression_quality.fit(docs, labels.where("quality = 1"))
    assert one.share == 1.0 and compression_quality.score(odd_docs, one).where("score = 1").count() == 14
    both = spark.createDataFrame([(1, 0, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    assert compression_quality.fit(docs, both).share == 0.5


def test_long_texts_are_compressed_whole():
    tail = compression_quality.sizes("a b c " * 3000 + "".join(chr(200 + i * 37 % 500) for i in range(5000)), b"", b"")
    assert tail[0] > 18_000 and tail[1] > 3000


def test_toxicity_on_labels_left_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    chain = toxicity_chain.fit(docs, labels.where(~part))
    assert [link.name for link in chain.links] == ["insult", "contempt", "disgust", "toxic"]
    assert [len(link.earlier) for link in chain.links] == [0, 1, 2, 3]
    rows = toxicity_chain.score(docs, chain).join(labels.where(part), "doc_id").collect()
    clean = [r for r in rows if r.toxic == 0]
    seeds = {w for words in toxicity_chain.SEEDS.values() for w in words}
    texts = {r.doc_id: set(r.text.lower().replace("!", " ").replace(",", " ").replace(".", " ").split()) for r in docs.join(labels.where(part), "doc_id").collect()}
    plain = [r for r in rows if r.toxic == 1 and len(texts[r.doc_id] & seeds) >= 3]
    assert plain and sum(r.predicted for r in plain) >= 0.95 * len(plain)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_toxicity_on_odd_rows(spark, odd_docs, no_docs, labels):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    chain = toxicity_chain.fit(docs, labels)
    got = toxicity_chain.score(odd_docs, chain)
    assert got.columns == ["doc_id", "p_insult", "p_contempt", "p_disgust", "p_toxic", "predicted"]
    assert got.where("predicted = 0").count() == 14
    assert toxicity_chain.score(no_docs, chain).count() == 0
    none = toxicity_chain.fit(docs, labels.limit(0))
    assert toxicity_chain.score(odd_docs, none).where("p_toxic = 0").count() == 14


def test_later_links_use_out_of_fold_predictions():
    """A category that is noise gets no trust from the next link, though its own fit on seen rows looks good."""
    rng = np.random.default_rng(2)
    n = 200
    texts = pa.array([" ".join(f"word{i}" for i in rng.integers(0, 400, 12)) for _ in range(n)])
    text, found = toxicity_chain.held_signs(texts)
    noise, fold = rng.integers(0, 2, n).astype(float), np.arange(n) % toxicity_chain.FOLDS
    chain = toxicity_chain.train(text, found, [("noise", noise), ("same", noise)], np.ones(n), fold, 0.5)
    assert abs(chain.links[1].earlier[0]) < 3


def test_word_beginnings_count():
    text, found = toxicity_chain.held_signs(pa.array(["alphabet alphabets", "alpha", None, ""]))
    first, second = set(found[text == 0].tolist()), set(found[text == 1].tolist())
    assert first & second == set(toxicity_chain.held_signs(pa.array(["alph"]))[1].tolist()) & first or first & second
    assert not len(found[text >= 2])


def test_dictionary_blocks_come_from_whole_texts(spark, monkeypatch):
    size = compression_quality.DICTIONARY_BLOCK_CHARS
    long = "".join(chr(97 + k) * size for k in range(20)) + "tail"
    rows = spark.createDataFrame([(1, 5, long), (1, 6, "short"), (1, 7, ""), (1, 8, None), (0, 9, "other")], "y int, o long, text string")
    whole = compression_quality._material(rows, 1)
    assert sorted(whole) == sorted([*(long[i : i + size] for i in range(0, len(long), size)), "short"])
    monkeypatch.setattr(compression_quality, "DICTIONARY_BLOCKS", 3)
    few = compression_quality._material(rows, 1)
    # each text gives one before any gives a second, and which one is not the first of the text
    assert len(few) == 3 and "short" in few[1:] and set(few) <= set(whole)
    assert compression_quality._material(rows, 0) == ["other"]
    assert compression_quality._material(rows.limit(0), 1) == []
