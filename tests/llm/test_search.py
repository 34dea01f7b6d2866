from __future__ import annotations

import math

import duckdb
import numpy as np
import pyarrow as pa

from weftline.llm import queries as Q
from weftline.llm import topk


def brute(rows, asked, k):
    ok = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in asked:
        if q in ok:
            best = sorted((-sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_odd_vectors_and_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 2)
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "SLICE", 2)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(60)]
    rows += [(60, None), (61, []), (62, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (63, [math.nan] * 6), (64, [math.inf] + [0.0] * 5), (None, [1.0] * 6), (65, [1.0, 2.0]), (70, [3.0, 1.0]), (80, None)]
    frame = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], "vec_id long, embedding array<float>, shard int, rank int")
    got = topk.top_k(frame, frame.filter("vec_id % 10 = 0"), k=7)
    assert {tuple(r) for r in got.collect()} == brute(rows, range(0, 90, 10), 7)
    assert topk.top_k(frame.filter("false"), frame.filter("false")).count() == 0


def test_blocks_below_the_kth_score_are_skipped():
    rng = np.random.default_rng(5)
    blocks = []
    for b in range(20):
        values = (rng.integers(-50, 50, (64, 8)) + 400 * (b == 3)).astype(np.int32)
        blocks.append((np.arange(64) + 64 * b, values, values.max(axis=0), values.min(axis=0)))
    query = np.abs(rng.integers(1, 50, (5, 8))).astype(np.int32)
    found, scored = topk.search(query, np.full(5, -1), np.full(5, np.iinfo(np.int64).min), blocks, 10)
    every, ids = np.concatenate([b[1] for b in blocks]), np.concatenate([b[0] for b in blocks])
    for i, got, scores in found:
        s = every.astype(np.int64) @ query[i]
        best = np.lexsort((ids, -s))[:10]
        assert got.tolist() == ids[best].tolist()
        assert scores.tolist() == s[best].tolist()
    assert scored == 5  # one block each


def test_components_of_any_size(spark):
    big = [(0, [3.0e6, -1.0]), (10, [-2.5e6, 4.0e6]), (1, [2.0e4, 1.0]), (2, [-2.0e4, 7.0]), (3, [0.5, 0.25])]
    frame = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    ok = {i: [math.floor(1024 * x) for x in v] for i, v in big}
    want = set()
    for q in (0, 10):
        best = sorted((-sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q)
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(r) for r in topk.top_k(frame, frame.filter("vec_id % 10 = 0")).collect()} == want


def test_only_surviving_blocks_reach_the_queries(spark):
    """Blocks whose bounds stay below the seeded score never join their forward index."""
    rng = np.random.default_rng(7)
    values = [np.clip(rng.normal(9.0 if b == 3 else 0.0, 1, 8), -5, None) for b in range(8) for _ in range(64)]
    index = topk._blocks(64, 1)(iter([pa.RecordBatch.from_arrays([pa.array(range(512), pa.int64()), pa.array([v.tolist() for v in values])], ["vec_id", "embedding"])]))
    rows = [{**{k: v[0] for k, v in b.to_pydict().items()}, "n": i, "query": False, "part": 0, "slice": 0, "least": None} for i, b in enumerate(index)]
    asked = np.abs(rng.integers(1, 9, (5, 8))).astype(np.int32)
    every = np.concatenate([topk._matrix(r["values"], 64, 8) for r in rows]).astype(np.int64)
    least = np.sort(asked @ every[192:256].T, axis=1)[:, -10].astype(np.int64)
    part = {"query": True, "part": 0, "slice": 0, "ids": np.arange(5).tobytes(), "values": asked.tobytes(), "dims": 8, "least": least.tobytes(), "n": None, "top": None, "low": None}
    schema = pa.schema([("query", pa.bool_()), ("part", pa.int64()), ("slice", pa.int32()), ("ids", pa.binary()), ("values", pa.binary()), ("dims", pa.int32()), ("least", pa.binary()), ("n", pa.int64()), ("top", pa.binary()), ("low", pa.binary())])
    batch = pa.RecordBatch.from_pylist([{k: r.get(k) for k in schema.names} for r in (part, *rows)], schema=schema)
    (kept,) = topk._surviving(iter([batch]))
    assert kept.column("n").to_pylist() == [3]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    want = set(con.execute(Q.ORACLE_SQL["op1_exact_top_k"]).fetchall())
    assert {tuple(r) for r in Q.op1_exact_top_k(spark, "/root/testdata/sf0.001").collect()} == want
