import pytest
from pyspark.sql import functions as F

from signalsieve.functions import fixed_values as fv
from signalsieve.functions.fixed_values import DEFAULT_RULES, RuleBook
from dataclasses import replace

from signalsieve.functions.phrases import ENGLISH
from signalsieve.operators.scoring import score_items
from signalsieve.operators.triage import triage, triage_join


def scored(spark, rows, **kw):
    df = spark.createDataFrame(
        [(i, t, body, site) for i, (t, body, site) in enumerate(rows)], "id long, title string, content string, site_name string"
    )
    return score_items(df, **kw).orderBy("id").collect()


def test_triage_order(spark):
    titles = ["Bank logs: netflix account", "Netflix ACCOUNT combolist", "combolist netflix account", "quiet post",
              "[bank] hi everyone", None]
    df = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    want = [
        ("analyze", "named target detected"), ("skip", "cracked streaming account"),
        ("skip", "cracked streaming account"), ("analyze", "passed default"),
        ("analyze", "named target detected"), ("analyze", "passed default"),
    ]
    skips = spark.createDataFrame([(i, k, r) for i, (k, r) in enumerate(fv.SKIP_PATTERNS)], "ord int, keyword string, reason string")
    names = spark.createDataFrame([(k,) for k in fv.NAMED_TARGETS], "keyword string")
    for out in (triage(df), triage_join(df, skips, names)):
        assert [(r.action, r.reason) for r in out.orderBy("id").collect()] == want


def test_triage_join_short_keywords(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "éx"), (3, "")], "id long, title string")
    skips = spark.createDataFrame([(0, "b", "one"), (1, "éx", "two"), (2, "a", "late")], "ord int, keyword string, reason string")
    names = spark.createDataFrame([], "keyword string")
    rows = triage_join(df, skips, names).orderBy("id").collect()
    assert [r.reason for r in rows] == ["one", "two", "passed default"]


def test_triage_join_odd_rules(spark):
    df = spark.createDataFrame([(1, "good target"), (1, "plain title"), (2, "old dump"), (3, "bare rule"), (4, None)], "id long, title string")
    skips = spark.createDataFrame([(-1, "old", "first"), (0, "dump", "second"), (1, "bare", None), (2, None, "x"), (3, "", "y")],
                                  "ord int, keyword string, reason string")
    names = spark.createDataFrame([("TARGET",), (None,)], "keyword string")
    rows = {(r.title, r.action, r.reason) for r in triage_join(df, skips, names).collect()}
    assert rows == {("good target", "analyze", "named target detected"), ("plain title", "analyze", "passed default"),
                    ("old dump", "skip", "first"), ("bare rule", "skip", None), (None, "analyze", "passed default")}


def test_vendor_beats_everything(spark):
    [r] = scored(spark, [("5 million email password telegram @x", "fresh combolist", "leakbase")])
    assert (r.score, r.category, r.tags, r.estimated_records) == (2, "general_discussion", ["vendor-ad", "low-value"], -1)
    assert (r.data_types, r.is_urgent, r.confidence_level) == ([], False, "low")
    assert r.reasoning == 'Rules: wording of sellers or spam, "telegram @"'


def test_combo_cap(spark):
    big, small = scored(spark, [("combolist 200 million email", "", "xss-is"), ("combolist 900 rows", "", "a")])
    assert (big.score, big.category, big.tags, big.data_types) == (4, "credential_leak", ["email", "combo-aggregate"], ["email"])
    assert small.score == 3 and small.tags == ["combo-aggregate"] and not big.is_urgent


def test_categories_each_branch(spark):
    cases = [
        ("database cvv", "database_dump"), ("cvv with rdp", "financial_data"), ("diagnosis sheet shell", "personal_info"),
        ("visit x.gov shell", "database_dump"), ("source code shell", "other"), ("rdp email", "access_sale"),
        ("email things", "credential_leak"), ("birthday data", "database_dump"), ("lockbit said", "database_dump"),
        ("a tutorial", "general_discussion"), ("quiet", "other"),
    ]
    rows = scored(spark, [(t, "", "s") for t, _ in cases])
    assert [r.category for r in rows] == [c for _, c in cases]
    [by_site] = scored(spark, [("quiet", "", "MyRansomBoard")])
    assert by_site.category == "database_dump" and by_site.tags == ["database_dump", "ransomware-site"]


def test_score_clamps_and_urgency(spark):
    rows = scored(spark, [
        ("200 million email password cvv diagnosis fresh", "", "leakbase"),  # above 10
        ("old stuff", "", "s"),  # below 1
        ("100,000 rows email password", "", "s"),  # 6+2, large, no fresh word
        ("99,999 rows email password cvv", "", "s"),  # 5+3, neither fresh nor large
        ("99,999 rows email password cvv latest", "", "s"),
        ("100,000 rows email password cvv from 2019", "", "s"),
    ])
    assert [r.score for r in rows] == [10, 1, 8, 8, 9, 7]
    assert [r.is_urgent for r in rows] == [True, False, True, False, True, False]
    assert [r.confidence_level for r in rows] == ["high", "low", "high", "high", "high", "high"]


def test_urgent_threshold_is_a_parameter(spark):
    row = ("100,000 rows email", "", "s")
    assert [scored(spark, [row], urgent_min_score=n)[0].is_urgent for n in (6, 7)] == [True, False]


def test_wording(spark):
    row = ("5 million email password latest", "", "")
    other = replace(ENGLISH, site_unknown="somewhere", types_joiner=" + ", fresh_note=" New!")
    [en], [own] = scored(spark, [row]), scored(spark, [row], phrases=other)
    assert en.summary == "unknown source: credential leak, about 5 million records, data types: email, password. Data looks recent."
    assert own.summary == "somewhere: credential leak, about 5 million records, data types: email + password. New!"
    assert en.reasoning == ("Rules: size 7, data types 2, recency 1, site 0: 10 points. "
                            "Records 5000000, types (email password)")


def test_custom_rules(spark):
    rules = RuleBook(vendor_patterns=["Spam Word"], tier1_sites=["good"]).with_types({"wallet": ["seed phrase"]})
    rows = scored(spark, [("a spam word", "", "s"), ("Seed PHRASE", "", "GOOD")], rules=rules)
    assert rows[0].score == 2 and rows[1].data_types == ["wallet"] and rows[1].tags[-1] == "tier1-forum"
    assert "wallet" not in DEFAULT_RULES.data_types


def test_nulls_and_empty(spark):
    [r] = scored(spark, [(None, None, None)])
    assert (r.score, r.category, r.tags) == (2, "other", ["other"])


def test_filter_on_result_does_not_repeat_the_scan(spark):
    df = spark.createDataFrame([(1, "t", "c", "s")], "id long, title string, content string, site_name string")
    plan = score_items(df).filter("score >= 5 and is_urgent")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2


@pytest.mark.parametrize("keep", [("id",), ("id", "site_name")])
def test_keep_columns(spark, keep):
    df = spark.createDataFrame([(1, "t", "c", "s")], "id long, title string, content string, site_name string")
    assert tuple(score_items(df, keep=keep).columns[: len(keep)]) == keep
