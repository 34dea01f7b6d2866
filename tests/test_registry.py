"""The registry over a stream against the batch store, a plain replay, and leases."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from weftline.sources import store
from weftline.streaming import registry as R

OPS = "token_sha string, db string, op string, ts timestamp, n long"
NOW = dt.datetime(2024, 1, 1)


def at(minutes):
    return NOW + dt.timedelta(minutes=minutes)


@pytest.fixture()
def run(spark, tmp_path):
    was = spark.conf.get(R.STORE, None)

    def go(batches, **options):
        """The decisions on batches, each of them a micro-batch of one stream that is started again."""
        out = str(tmp_path / "out")
        for i, batch in enumerate(batches):
            spark.createDataFrame(batch, OPS).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
            stream = spark.readStream.schema(OPS).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
            decided = R.registered(stream, **options)
            query = decided.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            assert query.awaitTermination(120)
        return sorted(((r.ts, r.n, r.token_sha, r.accepted, r.reason) for r in spark.read.schema(R.DECIDED).parquet(out).collect()), key=str)

    yield go
    spark.conf.set(R.STORE, was) if was else spark.conf.unset(R.STORE)


def test_refuses_what_the_batch_store_refuses(spark, run):
    rng = random.Random(1)
    rows = [(f"s{rng.randrange(12)}", rng.choice(["RB", "HB"]), "create", at(rng.randrange(5)), i) for i in range(40)]
    held = spark.createDataFrame([(f"s{i}", "RB", at(-9)) for i in range(4)], "token_sha string, db string, ts timestamp")
    got = run([rows], held=held)
    table = held.selectExpr("token_sha", "ts", "-1L as n", "db")
    _, refused = store.insert_tokens(table, spark.createDataFrame(rows, OPS).select("token_sha", "ts", "n", "db"))
    assert sorted(n for _, n, _, accepted, _ in got if not accepted) == sorted(r.n for r in refused.collect())


def test_replay_over_several_batches(run):
    rng = random.Random(2)
    batches = [[(f"s{rng.randrange(4)}", rng.choice(["RB", "HB"]), rng.choice(["create", "create", "destroy", "other"]), at(10 * b + rng.randrange(5)), 100 * b + i) for i in range(12)] for b in range(3)]
    owner, want = {}, []
    for batch in batches:
        for sha, db, op, ts, n in sorted(batch, key=lambda r: (r[3], r[4])):
            reason = "unknown operation"
            if op == "create":
                reason = f"held by {owner[sha]}" if sha in owner else ""
                owner.setdefault(sha, db)
            elif op == "destroy":
                reason = "" if owner.pop(sha, None) else "not found"
            want.append((ts, n, sha, not reason, reason))
    assert run(batches) == sorted(want, key=str)


def test_null_key_is_refused(run):
    assert [r[3:] for r in run([[(None, "RB", "create", at(0), 1)]])] == [(False, "no key")]


def test_leases_run_out(run):
    batches = [
        [("a", "HB", "create", at(0), 1), ("b", "RB", "create", at(0), 2)],
        [("a", "RB", "create", at(5), 3), ("b", "HB", "create", at(5), 4)],  # a is held for ten minutes, b for good
        [("a", "RB", "create", at(12), 5), ("z", "RB", "create", at(300), 6)],
        [("a", "HB", "create", at(301), 7), ("b", "HB", "create", at(301), 8)],
    ]
    got = {n: (accepted, reason) for _, n, _, accepted, reason in run(batches, leases={"HB": 600})}
    assert got == {1: (True, ""), 2: (True, ""), 3: (False, "held by HB"), 4: (False, "held by RB"), 5: (True, ""), 6: (True, ""), 7: (False, "held by RB"), 8: (False, "held by RB")}
