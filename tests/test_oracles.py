"""Every audit query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from plumbline.plans import records, stores  # noqa: F401
from plumbline.plans.audit import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels pages".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool | str):
        return v
    try:
        return float(v)
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(ORACLES)))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_all_have_sql_but_draws():
    assert set(QUERIES) - set(ORACLES) == {"separation", "bootstrap_ci", "ab_compare"}
