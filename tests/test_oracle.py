"""Every query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from weftline.plans import catalogue, flows, knowledge, lint, records, search, tokens

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLANS = (records, tokens, knowledge, catalogue, lint, search, flows)
QUERIES, SQL = ({k: v for p in PLANS for k, v in getattr(p, part).items()} for part in ("QUERIES", "SQL"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    if hasattr(x, "isoformat"):
        return x.isoformat()[:19]
    return repr(x)


def rows(columns, found):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(_value(r[i]) for i in at) for r in found)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    asked = duck.execute(SQL[name])
    names = [d[0] for d in asked.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, asked.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
