"""Operators over documents: edge cases and comparison with plain Python."""

import re
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from signalsieve.llm import decontamination, license_scan, mixing, ngram_join, quality_rules, queries, token_files

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- quality rules


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    count = Counter(zip(words, words[1:], words[2:]))
    held = set()
    for i, t in enumerate(zip(words, words[1:], words[2:])):
        if count[t] > 1:
            held |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(held))


def test_measures_on_odd_rows(odd_docs):
    got = quality_rules.text_measures(odd_docs, ("doc_id", "text")).collect()
    assert len(got) == 14
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(r.text)


def test_good_keeps_columns_and_drops_bad(odd_docs, no_docs):
    kept = quality_rules.good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_rules.judge(odd_docs).where("kept").collect()}
    assert quality_rules.good(no_docs).count() == 0


def test_cascade_order_never_changes_verdict(spark):
    df = spark.range(100).withColumn("x", F.col("id") % 10)
    a, b = quality_rules.Rule("a", F.col("x") > 6), quality_rules.Rule("b", F.col("x") < 2)
    for rules in ([a, b], [b, a]):
        got = quality_rules.cascade(df, rules, 10)
        assert got.where("rejected_by IS NULL").count() == 50
        assert [r.name for r in quality_rules.measured_order(df, [a], 10)] == ["a"]
    assert quality_rules.cascade(df, [], 10).where("rejected_by IS NULL").count() == 100


def test_cascade_stops_at_the_first_rejection(spark):
    """Measures that fail where they are computed are not computed behind a rule that rejects."""
    texts = quality_rules._worded(spark.createDataFrame([("short",), ("w " * 60,), (None,)], "text string"))
    found = quality_rules.measures(F.col("_text"), F.col("_words"))
    few, repeated = quality_rules.base_rules(found)
    late = quality_rules.Rule("late", F.when(found["n_words"] < 50, F.raise_error(F.lit("evaluated"))).otherwise(F.lit(False)))
    got = texts.select(quality_rules.first_rejection([few, late, repeated]).alias("by")).collect()
    assert [r.by for r in got] == ["few_words", "repeated_words", "few_words"]
    with pytest.raises(Exception, match="evaluated"):
        texts.where(quality_rules.first_rejection([late, few]).isNull()).collect()


def test_rules_are_ordered_by_rejections_per_cost(spark):
    """The costly rule that rejects no more than the cheap ones comes behind them, and is not computed before."""
    words = [" ".join(f"w{(i * k) % 997}" for i in range(3000)) for k in range(1, 40)] + ["a b"] * 40
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    found = quality_rules.measures(F.col("_text"), F.col("_words"))
    few, repeated = quality_rules.base_rules(found)
    none = quality_rules.Rule("none", found["n_symbols"] > 10 ** 9)
    order = [r.name for r in quality_rules.measured_order(
        docs, [none, repeated, few], 1000, quality_rules._worded)]
    assert order[0] == "few_words" and order[-1] == "none"
    plan = quality_rules.good(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") >= 1 and "n_repeat_words" not in plan and "CASE WHEN" in plan


# --- mixing


def fill(sizes, weights, cap=3):
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        weight = sum(weights[s] for s in sizes if s not in full)
        level = rest / weight if weight else 0
        new = {s for s in sizes if s not in full and weights[s] * level >= cap * sizes[s]}
        if not new:
            return {s: cap * sizes[s] if s in full else weights[s] * level for s in sizes}
        full |= new


def check_mix(rows):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = fill(sizes, {s: 1 + i % 3 for i, s in enumerate(order)})
    largest = max((r.size for r in rows), default=0)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= largest / 2 + 1
    return taken


def test_mix_on_documents(spark):
    rows = queries.op1_mixing(spark, SF).collect()
    assert len(rows) == 200
    check_mix(rows)
    again = queries.op1_mixing(spark, SF).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_mix_with_full_sources(spark):
    data = [(i, "w " * 10, "big") for i in range(400)] + [(1000 + i, "w " * 5, f"s{i % 2}") for i in range(8)] + [(2000, "w", None)]
    taken = check_mix(mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).collect())
    assert taken["s0"] == 60 and taken["s1"] == 60 and taken[None] == 3


def test_mix_without_broadcast_is_the_same(spark, docs, monkeypatch):
    first = sorted((r.doc_id, r.taken) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert first == sorted((r.doc_id, r.taken) for r in mixing.mix(docs).collect())


def test_budgets_nest(spark, docs):
    rows = docs.select(F.lit("s").alias("source_key"), mixing.word_count(F.col("text")).alias("size"), F.xxhash64("doc_id").alias("h"))
    total = rows.agg(F.sum("size")).first()[0]
    budgets = spark.createDataFrame([("s", k, total * k / 10.0) for k in range(11)], "source_key string, budget_id int, rest double")
    stops = [r.stop for r in mixing.thresholds(rows, budgets).orderBy("budget_id").collect()]
    assert stops == sorted(stops)
    path = F.shiftrightunsigned(F.col("h"), 64 - mixing.BITS * mixing.LEVELS)
    for k, stop in enumerate(stops):
        got = rows.where(path < stop).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        assert abs(got - total * k / 10) <= 10_000


def test_mix_on_odd_rows(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == 14
    check_mix(rows)
    out = mixing.mixed_corpus(odd_docs)
    assert out.columns == odd_docs.columns
    size = {(r.doc_id, r.text): len(WORD.findall(r.text or "")) for r in odd_docs.collect()}
    assert sum(size[r.doc_id, r.text] for r in out.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_corpus(no_docs).count() == 0


# --- n-gram join


def shingle_set(text, width):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute_components(rows, width=4, share=(85, 100)):
    sets = [shingle_set(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and share[1] * len(a & b) >= share[0] * len(a | b):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in groups[find(i)] if rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None) if sets[i] else doc_id))
    return sorted(out, key=repr)


def given(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_join_on_documents(spark, docs):
    assert given(queries.op3_ngram_join(spark, SF)) == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_join_on_odd_rows(odd_docs, no_docs):
    assert given(ngram_join.similar(odd_docs)) == brute_components([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert ngram_join.similar(no_docs).count() == 0


def near_copies(n):
    """Copies with a few words replaced: many pairs near the threshold, one long chain."""
    base = [f"b{i}" for i in range(90)]
    out = []
    for k in range(n):
        words = list(base)
        for j in range(k % 5):
            words[(k * 17 + j * 29) % 90] = f"n{k}_{j}"
        out.append((k, " ".join(words)))
    return out + [(1000 + k, " ".join(f"c{i}" for i in range(k, k + 60))) for k in range(0, 40)]


def test_join_in_chunks(spark, monkeypatch):
    rows = near_copies(120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    assert given(ngram_join.similar(df)) == want
    monkeypatch.setattr(ngram_join, "CHUNK_SETS", 7)
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", 3)
    assert given(ngram_join.similar(df)) == want


def test_rtree_finds_all_within_bound():
    import numpy as np

    rng = np.random.default_rng(3)
    points = rng.poisson(5, (300, 16)).astype(np.int32)
    points[::3] = points[0] + rng.integers(0, 2, (100, 16))
    sizes = points.sum(axis=1).astype(np.int64)
    tree = ngram_join.RTree(points, sizes)
    for i in range(0, 300, 7):
        near = 185 * np.minimum(points, points[i]).sum(axis=1) >= 85 * (sizes + sizes[i])
        assert sorted(tree.search(points[i], int(sizes[i]), (85, 100))) == np.flatnonzero(near).tolist()


def test_one_of_each(spark, odd_docs, no_docs):
    kept = ngram_join.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    # the prose group keeps id 1; texts without words all stay
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [1, 4, 5, 6, None, 7, 8, 10, 11]))
    assert ngram_join.one_of_each(no_docs).count() == 0


# --- decontamination


@pytest.fixture(scope="module")
def planted(spark):
    item = [f"item{i} gives{i % 7} a" for i in range(12)]
    words = " ".join(item).split()
    edited = list(words)
    edited[5], edited[17] = "other", "changed"
    filler = " ".join(f"f{i} g{i % 13}" for i in range(300))
    docs = [(1, filler + " " + " ".join(words) + " " + filler), (2, " ".join(edited).upper() + "!"), (3, filler),
            (4, None), (5, ""), (6, " ".join(words[:8]) + " " + filler), (None, "x, " + ", ".join(words)), (7, " ".join(words))]
    docs += [(7, " ".join(words))]
    bench = [(10, " ".join(words)), (11, "too short"), (12, None), (13, ""), (14, " ".join(words))]
    return (spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, _matches int"),
            spark.createDataFrame(bench, "item_id long, text string"))


def test_copies_are_found(planted):
    docs, bench = planted
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.matches(docs, bench).collect()}
    assert set(got) == {(d, i) for d in (1, 2, 7, None) for i in (10, 14)}
    assert got[1, 10] == got[7, 10] == 1.0 and 0.7 < got[2, 10] < 1.0
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]


def test_blocks_and_empty_tables(planted, monkeypatch):
    docs, bench = planted
    want = sorted(map(str, decontamination.matches(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 100)
    assert sorted(map(str, decontamination.matches(docs, bench).collect())) == want
    assert decontamination.matches(docs, bench.limit(0)).count() == 0
    assert decontamination.matches(docs.limit(0), bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == 9


@pytest.mark.parametrize("copies", [10, 11, 1000])
def test_part_shared_by_many_is_found(spark, copies):
    words, others = [f"word{i}" for i in range(20)], [f"other{i}" for i in range(20)]
    edited = [w if i % 6 else f"new{i}" for i, w in enumerate(others)]  # 6 of 17 seeds intact
    texts = [" ".join(["before", *part, "after"]) for part in (words[:10], edited)]
    phrase = " ".join(["so", *words[:4], "and", "no", "more"])
    docs = [(k * 3 + j, t) for k in range(copies) for j, t in enumerate([*texts, phrase])]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(others))], "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in decontamination.matches(table, bench).collect()) == [i for i, _ in docs if i % 3 < 2]
    assert sorted(r.doc_id for r in decontamination.decontaminate(table, bench).collect()) == [i for i, _ in docs if i % 3 == 2]


def test_long_run_of_a_long_item_is_found(spark):
    words = [f"word{i}" for i in range(59)]
    texts = [words[20:45], words[20:33], words[20:32], words[:18] + ["x"] + words[19:25]]
    docs = [(i, " ".join(["before", *t, "after"])) for i, t in enumerate(texts)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.score, r.first_word, r.last_word) for r in decontamination.matches(table, bench).collect()}
    assert got == {0: (25 / 59, 1, 25), 1: (13 / 59, 1, 13), 3: (47 / 118, 1, 25)}
    assert [r.doc_id for r in decontamination.decontaminate(table, bench).collect()] == [2]


def plain_local_score(a, b):
    best, before = 0, [0] * (len(a) + 1)
    for y in b:
        now = [0]
        for i, x in enumerate(a):
            now.append(max(0, before[i] + (2 if x == y else -1), before[i + 1] - 1, now[i] - 1))
        best, before = max(best, *now), now
    return best


def test_alignment_is_smith_waterman():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 30)), rng.integers(0, 5, rng.integers(1, 12))
        value, first, last = decontamination.align(a.astype(np.uint64), b.astype(np.uint64))
        assert value == plain_local_score(a.tolist(), b.tolist())
        if value:
            assert plain_local_score(a[first : last + 1].tolist(), b.tolist()) == value


def test_documents_with_whole_items(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id) for r in queries.op7_decontamination(spark, SF).collect()}
    whole = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench if b.text in d.text}
    assert whole and whole <= got
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    texts, items = {d.doc_id: words(d.text) for d in docs.collect()}, {b.item_id: words(b.text) for b in bench}
    for d, i in got - whole:
        assert plain_local_score(texts[d], items[i]) >= len(items[i])


# --- licences


def test_licences(spark, odd_docs, no_docs):
    mit = dict((n, t) for n, t in license_scan.TEMPLATES if n.endswith(":text"))["MIT:text"]
    pad = " ".join(f"p{i}" for i in range(333))
    docs = spark.createDataFrame(
        [(1, f"{pad} {mit.upper()} {pad}"), (2, "Licensed under CC BY-NC 4.0. " + pad), (3, pad), (4, None), (5, ""),
         (6, mit.replace("merge,", "")), (7, " ".join(mit.split()[:60])), (None, "Released under the MIT License."),
         (8, "This work is licensed under the GNU General Public License, version 3.")], "doc_id long, text string")
    got = {(r.doc_id, r.license): (round(r.containment, 2), r.first_word, r.last_word) for r in license_scan.scan(docs).collect()}
    assert set(got) == {(1, "MIT:text"), (2, "CC-BY-NC-4.0:statement"), (6, "MIT:text"), (None, "MIT:statement"),
                        (8, "GPL-3.0:statement")}
    assert got[1, "MIT:text"][:2] == (1.0, 333) and got[6, "MIT:text"][0] > 0.9
    assert license_scan.scan(odd_docs).count() == 0 and license_scan.scan(no_docs).count() == 0
    assert license_scan.scan(docs, []).count() == 0


def test_licences_on_documents(spark, docs):
    """Every text that holds enough of a template's shingles is found; the rest are versions that another outdoes."""
    import pyarrow as pa

    ready = license_scan.prepare(license_scan.TEMPLATES)
    got = {(r.doc_id, r.template_no) for r in queries.op8_license_scan(spark, SF).collect()}
    want = set()
    for d in docs.collect():
        _, own = license_scan.shingle_hashes(*license_scan.normal_words(pa.array([d.text])))
        held = set(own.tolist())
        want |= {(d.doc_id, t.no) for t in ready if len(held & set(t.shingles.tolist())) >= t.need}
    assert got <= want and {d for d, _ in got} == {d for d, _ in want}


# --- token files


def expected_tokens(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at, out = 0, []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    return out


def test_token_files_on_documents(spark, docs):
    got = [tuple(r) for r in queries.op9_token_files(spark, SF).orderBy("doc_id").collect()]
    assert got == expected_tokens([(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()])


def test_token_files_on_odd_rows(spark, odd_docs, no_docs, tmp_path):
    path = f"file://{tmp_path}/tokens"
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    token_files.encode(odd_docs, path, vocabulary)
    got = sorted((r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_back(spark, path).collect())
    order = odd_docs.orderBy("doc_id", F.xxhash64("text")).collect()
    assert got == sorted(t[1:] for t in expected_tokens([(r.doc_id, r.text) for r in order]))
    assert token_files.documents_by_id(spark, path, [2, 8]).count() == 3
    token_files.encode(no_docs, f"file://{tmp_path}/none", vocabulary)
    assert token_files.read_back(spark, f"file://{tmp_path}/none").count() == 0


def test_words_are_encoded_as_whole_texts_are():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, vocabulary = Tokenizer.from_file(path), open(path, encoding="utf-8").read()
    random.seed(5)
    parts = ["a", "B", "é", "É", "ß", "İ", "Σ", "'s", "'", "`", '"', ".", ",", "#", "1", "٣", " ", "  ", "\n", "\t", " ",
             "　", "́", "—", "“", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "漢", "😀", "_", "-", "'LL", "\x1c", "ﬁ"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 40))) for _ in range(3000)] + ["", None]
    starts, ids = token_files.encode_texts(pa.array(texts), vocabulary, 2)
    for k, text in enumerate(texts):
        assert ids[starts[k] : starts[k + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
