"""Whitening against numpy on whole numbers, exact deviations and odd rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Row

from weftline.llm import queries as Q
from weftline.llm import whitening as W

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>"


def whole(vectors):
    return [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]


def test_query_by_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array(whole([r.embedding for r in rows]), object)
    n, sums = len(x), x.sum(axis=0)
    apart = x * n - sums
    centred = (apart / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    want = centred @ axes[:, :32] / np.sqrt(values[:32])
    got = Q.op11_embedding_whitening(spark, SF)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    table = np.zeros((n, 32))
    place = {r.vec_id: i for i, r in enumerate(rows)}
    found = got.collect()
    assert len(found) == 32 * n
    for r in found:
        table[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == int((apart[place[r.vec_id]] ** 2).sum())
        assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9)
        assert r.identity_error < 1e-9
    sign = np.sign((table * want).sum(axis=0))
    assert np.allclose(table, want * sign, atol=1e-6)


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, -1.0]), (2, [3.0, -1.0]), (None, [0.0, 0.5]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("-inf"), 1.0]), (7, []), (8, [1.0]), (9, [4.0, 4.0])]
    vectors = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'own' as x", "7 as deviation", "'kept' as n")
    model = W.fit(vectors)
    assert (model.n, model.dims) == (5, 2)
    got = W.whiten(vectors, model).collect()
    assert sorted((r.vec_id or 0) for r in got) == [0, 1, 2, 2, 9]
    assert all(r.n == "kept" and len(r.whitened) == 2 for r in got)
    x = np.array(whole([v for _, v in (rows[0], rows[1], rows[2], rows[3], rows[10])]))
    assert sorted(r.deviation for r in got) == sorted(((5 * x - x.sum(axis=0)) ** 2).sum(axis=1).tolist())
    assert W.identity_error(W.whiten(vectors, model), model) < 1e-12


def test_without_rows_or_variance(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert W.fit(none) is None
    assert W.whiten(none, None).count() == 0
    same = spark.createDataFrame([Row(vec_id=i, embedding=[1.0, 2.0]) for i in range(4)], SCHEMA)
    model = W.fit(same)
    assert len(model.values) == 0
    assert W.whiten(same, model).count() == 0
    flat = spark.createDataFrame([Row(vec_id=i, embedding=[float(i), 2.0 * i, 5.0]) for i in range(6)], SCHEMA)
    assert len(W.fit(flat).values) == 1  # the other eigenvalues are zero


def test_far_components_are_exact(spark):
    rows = [(i, [float(2.0**40) * (-1) ** i, 1e30 if i == 3 else float(i)]) for i in range(8)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    model = W.fit(vectors)
    x = np.array([[min(max(c, -W.FAR + 1_000_000), W.FAR + 1_000_000) for c in v] for v in whole([v for _, v in rows])], object)
    apart = x * 8 - x.sum(axis=0)
    exact = apart.T @ apart / 8**3
    values = np.linalg.eigvalsh(exact.astype(float))[::-1]
    assert np.allclose(model.values, values[: len(model.values)], rtol=1e-9)
    assert model.trace == float(np.trace(exact.astype(float)))
    got = {r.vec_id: r.deviation for r in W.whiten(vectors, model).collect()}
    assert got == {i: min(int((apart[i] ** 2).sum()), 2**63 - 1) for i in range(8)}
