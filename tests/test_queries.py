"""Every registered core query against its SQL over the smallest tables."""

import math

import duckdb
import pytest

from lodestar.plans import lifecycle, relational, texts, vectors  # noqa: F401
from lodestar.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    a = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    b = sorted(tuple(plain(v) for v in (dict(zip(want.columns, row, strict=True))[c] for c in order)) for row in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_answers_are_whole_turns(spark, con):
    got = sorted(r["answer"] for r in QUERIES["answer_pairs"](spark, SF).collect())
    want = [t.strip() for (t,) in con.sql("SELECT text FROM conversations WHERE role = 'assistant'").fetchall()]
    assert got == sorted(t for t in want if t)
