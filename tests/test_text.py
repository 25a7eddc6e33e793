import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from signalsieve.functions import fixed_values as fv
from signalsieve.functions import text as T
from signalsieve.functions.keywords import KeywordIndex
from signalsieve.functions.matching import any_contains, contained_words
from signalsieve.functions.numbers import max_records, records_score


def test_strip_html(values):
    got = values(T.strip_html, ["<p>a</p>\n\n<b>b</b>", " x&amp;y ", "You MUST be registered for see images attach ok", " a　", ""])
    assert got == ["a b", "x&amp;y", "ok", "a", ""]


def test_download_links(values):
    got = values(
        T.download_links,
        [
            "get https://a.org/f.zip, and https://a.org/f.zip again",
            'x <a href="https://b.org/page">y</a> https://b.org/i.png',
            "Download： https://c.org/x). https://c.org/files/q;",
            "HTTPS://UP.org/f.zip only",
            "no link",
            "https://mega.nz/abc https://d.org/login/f.zip http://e.org/a.PDF",
        ],
    )
    assert got == [
        ["https://a.org/f.zip"],
        ["https://b.org/page"],
        ["https://c.org/x", "https://c.org/files/q"],
        [],
        [],
        ["http://e.org/a.PDF", "https://mega.nz/abc"],
    ]


def test_titles_and_previews(values):
    assert values(lambda x: T.prefix_title(x, F.lit("s")), ["a", "[g] a", ""]) == ["[s] a", "[g] a", "[s] "]
    assert values(lambda x: T.preview(x, 3), ["abc", "abcd", "äöüß"]) == ["abc", "abc…", "äöü…"]
    assert values(lambda x: T.shorten(x, 5), ["abcde", "abcdef"]) == ["abcde", "ab..."]
    assert values(lambda x: T.shorten(x, 3), ["abcdef"]) == ["abc"]


def test_badges_escapes_and_numbers(values, spark):
    assert values(T.site_badge, ["LeakBase", "in4x", "mycard", "ransomwatch", "HIBP feed", "zzz"]) == [
        "t1", "t2", "t3", "t-ransom", "t-intel", "t4"]
    assert values(T.escape_markup, ["a_b.c!", "x\\y"]) == ["a\\_b\\.c\\!", "x\\y"]
    assert values(T.escape_url, ["a(b)\\_"]) == ["a(b\\)\\\\_"]
    assert values(lambda x: T.comma_number(x.cast("int")), ["1234567", "999"]) == ["1,234,567", "999"]
    assert values(lambda x: T.score_badge(x.cast("int")), ["10", "8", "5", "4"]) == ["🔴", "🟠", "🟡", "🔵"]


def test_source_names(values):
    assert values(T.normalize_key, [" Breach.Forums (RS)-x "]) == ["breach_forums_rs_x"]
    assert values(T.sanitize_name, ["A (Mirror 2)", "B (onion) (Deep web)", "C (market)"]) == ["A", "B", "C (market)"]


def test_max_records_edges(values):
    cases = {
        "0.5 rows": 0, "1.2.3m": -1, "5. million": 5_000_000, "3,000,000 users": 3_000_000,
        "9999 billion": fv.MAX_RECORDS, "x5m": -1, "é5m": 5_000_000, "5mé": 5_000_000, "none": -1,
        "120k lines and 7 bln": fv.MAX_RECORDS, "2 entries": 2, "2 entriess": -1, "10 k, 20 rows": 10_000,
        "1,500 rows": 1500, "5b": fv.MAX_RECORDS, "0.4b": 400_000_000, "7 thousands": -1, "": -1,
    }
    assert values(max_records, list(cases)) == list(cases.values())


def test_records_score_steps(values):
    for low, score in fv.RECORD_SCORE_STEPS:
        below = {9: 8, 8: 7, 7: 6, 6: 5, 5: 4, 4: 3, 3: 2}[score]
        assert values(lambda x: records_score(x.cast("int")), [str(low), str(low - 1)]) == [score, below]


def test_matching_helpers(values):
    assert values(lambda x: any_contains(x, ["b", "ab"]), ["xaby", "", None]) == [True, False, False]
    assert values(lambda x: contained_words(x, ["a", "c", "b"]), ["abc"]) == [["a", "c", "b"]]


def test_keyword_index_equals_contains(spark):
    words = fv.NAMED_TARGETS + [k for k, _ in fv.SKIP_PATTERNS] + fv.VENDOR_PATTERNS + [
        w for ws in fv.DATA_TYPES.values() for w in ws]
    index = KeywordIndex(words)
    rng = random.Random(5)
    pieces = words + ["x", " ", "e", "ma", "combo", "é", "pas"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 6)))[rng.randint(0, 2):] for _ in range(1500)]
    rows = spark.createDataFrame([(t.lower(),) for t in texts], "t string")
    out = rows.select(
        "t", F.filter(F.lit(index.words), lambda w: F.exists(index.hits(F.col("t")), lambda h: h.startswith(w))).alias("got")
    ).collect()
    for r in out:
        assert r.got == [w for w in index.words if w in r.t], r.t


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab[]^-\\&.*(", min_size=1, max_size=4), min_size=1, max_size=8),
       st.lists(st.text(alphabet="ab[]^-\\&.*(", max_size=12), min_size=1, max_size=8))
def test_keyword_index_special_characters(spark, words, texts):
    index = KeywordIndex(words)
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    out = rows.select("t", index.any(index.hits(F.col("t")), words).alias("got"),
                      index.first(index.hits(F.col("t")), [(w, w) for w in words]).alias("first")).collect()
    for r in out:
        assert r.got == any(w in r.t for w in words)
        assert r["first"] == next((w for w in words if w in r.t), None)
