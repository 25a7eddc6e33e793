"""Every registered query against its SQL at the smallest scale."""

import os
import re
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))
import __spark_entry__ as entry  # noqa: E402
from verify import TABLES, _rows  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        assert got[1]
        return
    res = db.execute(ORACLES[name])
    assert got == _rows([d[0] for d in res.description], res.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_operator_is_registered():
    ids = {m.group(1) for n in QUERIES if (m := re.match(r"([a-z]+\d+)_", n))}
    want = {f"{family}{i}" for family, n in
            dict(s=6, c=13, t=11, d=7, f=4, r=16, l=7, q=17, p=11, n=7, st=5).items() for i in range(1, n + 1)}
    assert want <= ids
