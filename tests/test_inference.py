from signalsieve.operators import inference as L
from pyspark.sql import functions as F


def test_signals(values):
    got = values(lambda x: L.signals(x, F.lit("")), [
        "1.5 million records and 2 TB, CVE-2024-12345 cve-2023-0001", "plain", "PASSPORT and iban", "300,000users",
        " ".join(f"CVE-2024-{1000 + i}" for i in range(7))])
    assert got[0] == "PreExtracted:\n  Records: 1.5 million records\n  DataSize: 2 TB\n  CVEs: CVE-2024-12345, cve-2023-0001"
    assert got[1] is None
    assert got[2] == "PreExtracted:\n  SensitiveFields: passport, iban"
    assert got[3] == "PreExtracted:\n  Records: 300,000users"
    assert got[4].count("CVE-") == 7
    assert values(lambda x: L.signals(x, F.lit(""), 5), [" ".join(f"CVE-2024-{1000 + i}" for i in range(7))])[0].count("CVE-") == 5


def test_parse_result(spark):
    texts = ['{"score": 7, "category": "x", "tags": ["a"], "other": {}}', '{"score": 7', "", None, '{"score": 0, "category": "x"}',
             '{"score": 11, "category": "x"}', '{"score": 3, "category": ""}', '{"category": "x"}', '{"score": "x", "category": "x"}',
             '{"score": 7.5, "category": "x"}', '{"score": 7, "category": "x"} Hope this helps',
             '{"score": 7, "category": "x"}\n{"score": 8, "category": "x"}', ' {"score": 7, "category": "x"}\n ']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, json string")
    rows = L.parse_result(df).orderBy("i").collect()
    assert [r.error for r in rows] == [
        None, "unparsable result", "unparsable result", "unparsable result", "score 0 out of range [1, 10]",
        "score 11 out of range [1, 10]", "category is empty", "score 0 out of range [1, 10]", "unparsable result",
        "unparsable result", "unparsable result", "unparsable result", None]
    assert rows[0].result.tags == ["a"] and rows[0].result.data_types == [] and rows[1].result is None


def test_chain_falls_through_to_the_default(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    good = '{"score": 6, "category": "x"}'
    results = spark.createDataFrame(
        [(1, "b", 1, good, None), (1, "a", 0, "bad", None), (2, "a", 0, good, "timeout")],
        "item_id long, provider string, ord int, json string, error string")
    rows = {r.item_id: r for r in L.provider_chain(items, results, None).collect()}
    assert rows[1].model_used == "b" and rows[1].result.score == 6
    assert rows[2].model_used == "fallback" and rows[2].result.tags == ["fallback"] and rows[3].result.score == 1


def test_infer_isolates_errors(spark):
    def scorer(row):
        if row["id"] == 2:
            raise RuntimeError("down")
        return {"score": int(row["id"]), "category": "x"}

    items = spark.createDataFrame([(1, "t"), (2, "t"), (3, "t")], "id long, title string")
    rows = {r.item_id: r for r in L.infer(items, scorer).collect()}
    assert rows[2].error == "RuntimeError: down" and rows[2].json is None
    assert rows[3].error is None and '"score": 3' in rows[3].json


def test_rubric(spark):
    df = spark.createDataFrame([(1, 5, "low", False), (2, 4, "low", True), (3, 9, "high", True)],
                               "id long, score int, confidence_level string, is_urgent boolean")
    assert {r.id: r.violations for r in L.rubric_check(df).collect()} == {
        1: ["low confidence above 4"], 2: ["urgent below 8"]}


def test_the_parser_stands_once_in_a_plan(spark, tmp_path):
    df = spark.createDataFrame([(1, "p", 0, "{}", None)], "item_id long, provider string, ord int, json string, error string")
    df.write.parquet(str(tmp_path / "r"))
    plan = L.first_valid(spark.read.parquet(str(tmp_path / "r")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1
