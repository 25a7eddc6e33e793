"""Token counts against the tokenizer on each whole text; what the cache saves."""

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from signalsieve.llm import token_counts

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def plain(texts, path=BYTES):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(model.encode(t or "")) for t in texts]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return [len(model.encode(t or "", add_special_tokens=False).ids) for t in texts]


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(*token_counts._read(BYTES))


ODD = ["", " ", "  ", "a  b", "a \n b", "a\nb\nc", "a\n\nb", " a", "a ", "a b c", "don't  we'll", "x <|endoftext|> y", "x  <|endoftext|>  y",
       "<|endoftext|>", "a\n<|endoftext|>\nb", "a <|endo ftext|>", "\x1e", "a \x1e b", "a\x85 b", "a\xa0 b c", "　 a b", "中文 字 12 34", "é è ê",
       "a​ b", "a\t b", "﻿ a b", "a 1 2 3", "a . b , c", "🙂 🙂 b", "a\r\nb", "  a b c", "aaa " * 500, "0 " * 300]


def test_cut_texts_have_the_same_tokens(counter):
    assert counter.cuts
    assert counter.count(pa.array(ODD)).tolist() == plain(ODD)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 1.'\n\t\r\x1e\x85\xa0éß中 ​<|>s"), max_size=25), max_size=4))
def test_any_text(texts):
    counter = token_counts._counter(*token_counts._read(BYTES))
    texts = [*texts, " <|endoftext|> ".join(texts), "<|endoftext|>".join(texts)]
    assert counter.count(pa.array(texts)).tolist() == plain(texts)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_whole_table(spark, odd_docs, tmp_path, name):
    path = public_tokenizers.path(name)
    found = sorted(map(repr, token_counts.count_tokens(odd_docs, str(tmp_path / "c"), path).collect()))
    rows = odd_docs.select("doc_id", "text").collect()
    assert found == sorted(
        f"Row(doc_id={r.doc_id}, n_bytes={len((r.text or '').encode())}, n_tokens={n})"
        for r, n in zip(rows, plain([r.text for r in rows], path)))


@pytest.fixture
def encoded(monkeypatch, spark):
    """The digests that runs sent to a tokenizer."""
    sent = []
    encode = token_counts._encode

    def spied(texts, vocabulary_file):
        sent.append([bytes(r.digest) for r in texts.select("digest").collect()])
        return encode(texts, vocabulary_file)

    monkeypatch.setattr(token_counts, "_encode", spied)
    return sent


@pytest.mark.parametrize("few", [0, 1_000])
def test_only_distinct_misses_are_encoded(spark, tmp_path, encoded, monkeypatch, few):
    monkeypatch.setattr(token_counts, "FEW_DIGESTS", few)
    cache = str(tmp_path / "cache")
    docs = spark.createDataFrame([(i, "the same text" if i % 3 else f"text {i // 2}") for i in range(60)], "doc_id long, text string")
    docs = docs.repartition(4)
    first = sorted(token_counts.count_tokens(docs, cache, BYTES).collect())
    texts = {r.text for r in docs.collect()}
    assert len(encoded) == 1 and len(encoded[0]) == len(set(encoded[0])) == len(texts)
    assert sorted(token_counts.count_tokens(docs, cache, BYTES).collect()) == first and len(encoded) == 1
    more = docs.unionByName(spark.createDataFrame([(99, "new"), (100, "new"), (101, "the same text")], docs.schema))
    again = token_counts.count_tokens(more, cache, BYTES).collect()
    assert len(encoded) == 2 and len(encoded[1]) == 1
    assert len(again) == 63 and {r.n_tokens for r in again if r.doc_id in (99, 100)} == set(plain(["new"]))
    # another tokenizer finds nothing of the first one's
    token_counts.count_tokens(docs, cache, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(encoded[2]) == len(texts)
    assert spark.read.parquet(cache).groupBy("tokenizer").count().count() == 2


def test_a_digest_appended_twice_counts_once(spark, tmp_path):
    cache = str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    first = sorted(token_counts.count_tokens(docs, cache, BYTES).collect())
    kept = spark.read.parquet(cache).collect()
    spark.createDataFrame(kept, "digest binary, n_tokens long, tokenizer string").write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert sorted(token_counts.count_tokens(docs, cache, BYTES).collect()) == first


def test_a_normal_form(spark, tmp_path, encoded):
    """A tokenizer that lower-cases and drops white space at the ends may share counts of such texts."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "One Two"), (2, " one two "), (3, "one")], "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    found = token_counts.count_tokens(docs, str(tmp_path / "c"), path, lambda t: F.trim(F.lower(t))).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in found} == {1: (7, 2), 2: (9, 2), 3: (3, 1)}
    assert len(encoded[0]) == 2


def test_no_documents(spark, no_docs, tmp_path):
    assert token_counts.count_tokens(no_docs, str(tmp_path / "c"), BYTES).count() == 0
    assert not (tmp_path / "c").exists()
