"""The stages of the corpus pipeline against plain Python, each on its own input."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from test_document_operators import brute_components, expected_tokens, measures, plain_local_score

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    from signalsieve.llm.shared import written

    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out[name] = (docs, written(stage(spark, docs, SF), "test-stage"))
        docs = out[name][1]
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_join", "decontamination", "mixing", "token_files"]
    assert all(after.columns == COLUMNS for name, (_, after) in stages.items() if name != "token_files")


def test_quality_stage(stages):
    before, after = stages["quality_rules"]

    def good(text):
        n, chars, symbols, lines, repeats = measures(text)
        return n >= 50 and 100 * repeats <= 50 * n and 10 * symbols <= n and 2 * n <= chars <= 15 * n and 20 * lines <= n

    assert rows(after) == [r for r in rows(before) if good(r[1])]
    assert 0 < after.count() < before.count()


def test_join_stage(stages):
    before, after = stages["ngram_join"]
    given = rows(before)
    component = {doc_id: c for doc_id, _, c in brute_components([r[:2] for r in given], 5, (80, 100))}
    assert rows(after) == [r for r in given if component[r[0]] == r[0]]


def test_decontamination_stage(stages, spark):
    before, after = stages["decontamination"]
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(i[k : k + 4]) for i in items for k in range(len(i) - 3)}

    def leaks(text):
        w = words(text)
        if not any(tuple(w[k : k + 4]) in grams for k in range(len(w) - 3)):
            return False
        return any(plain_local_score(w, i) >= len(i) for i in items if any(
            tuple(i[k : k + 4]) in {tuple(w[j : j + 4]) for j in range(len(w) - 3)} for k in range(len(i) - 3)))

    assert rows(after) == [r for r in rows(before) if not leaks(r[1])]
    assert after.count() < before.count()


def test_mixing_stage(stages):
    before, after = stages["mixing"]
    times = Counter(rows(after))
    assert set(times) <= set(rows(before)) and max(times.values()) <= 3
    size = lambda r: len(re.findall("[^\x20\x09-\x0d]+", r[1]))
    total, taken = sum(map(size, rows(before))), sum(size(r) * n for r, n in times.items())
    assert abs(taken - total) < 0.35 * total  # targets are near, and a source has a handful of documents here


def test_token_stage(stages):
    before, after = stages["token_files"]
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in after.collect())
    want = expected_tokens([r[:2] for r in sorted(rows(before), key=lambda r: r[0])])
    assert [(d, s, n, c) for s, d, n, c in got] == want


def test_run_is_the_stages(stages, spark):
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted(tuple(r) for r in stages["token_files"][1].collect())
