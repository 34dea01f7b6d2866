"""Levels and cycles of dependencies, bounded loops, attempts and sketches against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import loops, sketches, traverse


def plain_levels(nodes, edges):
    needs = {n: {b for a, b in edges if a == n and b != n} for n in {*nodes, *(x for e in edges for x in e)}}
    level, k = {}, 0
    while ready := [n for n in needs if n not in level and needs[n] <= {*level}]:
        level |= dict.fromkeys(ready, k)
        k += 1
    return {n: level.get(n) for n in needs}


def plain_cycles(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {b for a, b in edges if a == n and b != n} for n in nodes}
    for k in nodes:
        for n in nodes:
            if k in reach[n]:
                reach[n] |= reach[k]
    return {n: min({n} | {m for m in nodes if m in reach[n] and n in reach[m]}) for n in nodes if n in reach[n] and any(m != n and n in reach[m] for m in reach[n])}


@pytest.mark.parametrize("seed,many", [(1, 25), (2, 45), (3, 12)])
def test_levels_and_cycles(spark, seed, many):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(many)]
    edges += [("n1", "n1"), edges[0]]
    df = spark.createDataFrame([*edges, (None, "n1"), ("n2", None)], "node string, needs string")
    nodes = spark.createDataFrame([("alone",), (None,)], "node string")
    got = {r.node: r.level for r in traverse.levels(df, nodes).collect()}
    assert got == plain_levels({"alone"}, edges)
    assert {r.node: r.cycle for r in traverse.cycles(df).collect()} == plain_cycles(edges)


def test_levels_of_nothing(spark):
    none = spark.createDataFrame([], "node string, needs string")
    assert traverse.levels(none, none.select("node")).count() == 0
    assert traverse.cycles(none).count() == 0


def test_loops_end_where_scripts_end(spark):
    rows = spark.createDataFrame([(i, i, "kept") for i in [*range(0, 60), 97, None]], "id long, n long, other string")
    on = lambda s: (s["n"] != 1) & (s["n"] != 7)
    step = lambda s: {"n": F.when(s["n"] == 27, None).when(s["n"] % 2 == 0, s["n"] / 2).otherwise(3 * s["n"] + 1)}
    for most in (1, 9, 60):
        got = {r.id: (r.n, r.steps, r.outcome, r.other) for r in loops.repeat_while(rows, ["n"], on, step, most).collect()}
        for i in got:
            n, k = i, 0
            while n is not None and n not in (1, 7) and k < most:
                n, k = None if n == 27 else n // 2 if n % 2 == 0 else 3 * n + 1, k + 1
            assert got[i] == (n, k, "failed" if n is None else "done" if n in (1, 7) else "limit", "kept"), i


def test_the_default_bound(spark):
    got = loops.repeat_while(spark.createDataFrame([(0, 3), (1, 9998)], "id int, n int"), ["n"], lambda s: s["n"] != 10_000, lambda s: {"n": s["n"] + F.when(s["n"] < 5, 0).otherwise(1)}).orderBy("id").collect()
    assert [(r.n, r.steps, r.outcome) for r in got] == [(3, 10_000, "limit"), (10_000, 2, "done")]


def test_attempts_and_cancellation_lose_no_row(spark):
    rows = spark.createDataFrame([(1, "4"), (2, "x"), (0, "4"), (None, "4"), (2, None)], "d int, v string")
    good, bad = loops.tried(rows, {"q": F.try_divide(F.col("v").try_cast("int"), "d")}, "division")
    assert [tuple(r) for r in good.collect()] == [(1, "4", 4.0)]
    assert sorted(map(str, bad.select("d", "v").collect())) == sorted(map(str, rows.filter("not (d <=> 1)").collect()))
    kept, gone = loops.cancelled(rows, F.col("d") > 1, "cancelled")
    assert (kept.count(), gone.count()) == (3, 2) and {r.reason for r in gone.collect()} == {"cancelled"}


def test_sketches_merge_within_two_percent(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select("l_linenumber", "l_orderkey")
    table = sketches.by_group(rows, "l_linenumber", "l_orderkey").cache()
    exact = dict(rows.groupBy("l_linenumber").agg(F.count_distinct("l_orderkey")).collect())
    for r in sketches.estimated(table).collect():
        assert r.distinct_hll == pytest.approx(exact[r.l_linenumber], rel=0.02) and r.distinct_theta == pytest.approx(exact[r.l_linenumber], rel=0.02)
    some = [2, 5, 6]
    union = sketches.estimated(sketches.merged(table.filter(F.col("l_linenumber").isin(some)))).first()
    chosen = rows.filter(F.col("l_linenumber").isin(some))
    assert union.n == chosen.count()
    assert union.distinct_hll == pytest.approx(chosen.select("l_orderkey").distinct().count(), rel=0.02)
    both = {(r.left, r.right): r.common for r in sketches.overlaps(table, "l_linenumber").collect()}
    air, rail = (rows.filter(F.col("l_linenumber") == m).select("l_orderkey").distinct() for m in (3, 6))
    assert both[3, 6] == pytest.approx(air.intersect(rail).count(), rel=0.05)


def test_sketches_of_many_groups_stay_within_two_percent(spark):
    rows = spark.range(60 * 30_000).selectExpr("id % 60 as g", "id * 7 as v")
    got = sketches.estimated(sketches.by_group(rows, "g", "v")).collect()
    assert all(x == pytest.approx(30_000, rel=0.015) for r in got for x in (r.distinct_hll, r.distinct_theta))


def test_rings_behind_rings_take_few_rounds(spark, monkeypatch):
    """Rings in a row, each with a long way to the next: rounds don't follow the length of the row."""
    rings = [[100 * k + i for i in (1, 2, 3)] for k in range(8)]
    edges = [e for a, b, c in rings for e in ((a, b), (b, c), (c, a))]
    edges += [(step + 1, step) for low, high in zip(rings, rings[1:]) for step in (low[2] + 10, low[2] + 11)] + [e for low, high in zip(rings, rings[1:]) for e in ((high[0], low[2] + 12), (low[2] + 10, low[2]))]
    want = {n: ring[0] for ring in rings for n in ring}
    steps = []
    monkeypatch.setattr(traverse, "cut", lambda df, real=traverse.cut: (steps.append(1), real(df))[1])
    assert {r.node: r.cycle for r in traverse.cycles(spark.createDataFrame(edges, "node long, needs long")).collect()} == want
    assert len(steps) <= 20
    turned = spark.createDataFrame([(b, a) for a, b in edges[:9] + edges[24:26] + edges[-14:-10]], "node long, needs long")
    assert {r.node: r.cycle for r in traverse.cycles(turned).collect()} == {n: ring[0] for ring in rings[:3] for n in ring}
