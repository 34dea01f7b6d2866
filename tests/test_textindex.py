"""The stored index against a plain search; batches, a stream and compaction against a new index; what a plan reads."""

from __future__ import annotations

import math
import random
import re
import unicodedata

import pytest

from weftline.sources import textindex as X

CHANGE = "token_sha string, module string, content string, deleted boolean, version int"


def plain_terms(text):
    plain = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", plain)


def plain_search(rows, query, module=None, most=30):
    docs = {sha: (m, plain_terms(text)) for sha, m, text in rows}
    n, total = len(docs), sum(len(t) for _, t in docs.values())
    scores = {}
    for words in filter(None, map(plain_terms, query.split())):
        tf = {sha: sum(t[i : i + len(words)] == words for i in range(len(t))) for sha, (_, t) in docs.items()}
        df = sum(v > 0 for v in tf.values())
        for sha, f in tf.items():
            if f:
                part = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(docs[sha][1]) * n / total))
                scores[sha] = scores.get(sha, 0) + part
    best = sorted(((-round(s, 9), sha) for sha, s in scores.items() if module is None or docs[sha][0] == module))[:most]
    return [(sha, -s) for s, sha in best]


def made(n, seed):
    rng = random.Random(seed)
    words = ["fn1(x)", "Café", "cafe", "naïve", "a_b", "x", "Zoë's", "fn1", "2nd", "—", "ŽLUŤ", "été"]
    return [(f"t{i}", f"m{rng.randrange(3)}", " ".join(rng.choices(words, k=rng.randrange(0, 9)))) for i in range(n)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    rows = [*made(150, 1), ("null", "m0", None)]
    X.build(spark.createDataFrame([*rows, rows[0]], "token_sha string, module string, content string"), path, buckets=8)
    return path, rows


@pytest.mark.parametrize("query,module", [("fn1(x)", None), ("CAFE été zlut", None), ("x fn1(x) zoë's", "m1"), ("x_x a_b", None), ("never", None), ("— ()", None), ("", "m1")])
def test_search_by_brute_force(spark, index, query, module):
    path, rows = index
    got = [(r.token_sha, r.score) for r in X.search(spark, path, query, module=module).collect()]
    want = plain_search(rows, query, module)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want])


def test_only_asked_buckets_are_read(spark, index):
    path, _ = index
    plan = X.read(spark, path, ["cafe"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=)", plan) and "EqualTo(term,cafe)" in plan
    assert "content" not in plan


def state(spark, path):
    return sorted((r.term, r.token_sha, r.module, r.length, tuple(r.positions)) for r in X.read(spark, path).collect()), X.totals(spark, path).first()


def test_batches_stream_and_compaction_agree(spark, tmp_path):
    rows = made(60, 2)
    start = spark.createDataFrame(rows, "token_sha string, module string, content string")
    rng = random.Random(3)
    batches = [[(f"t{rng.randrange(70)}", f"m{rng.randrange(3)}", f"new{b} words {rng.randrange(9)}", rng.random() < 0.3, v) for v in range(25)] for b in range(3)]
    now = {r[0]: r for r in rows}
    for batch in batches:
        for sha, v in {sha: max(c[4] for c in batch if c[0] == sha) for sha, *_ in batch}.items():
            (change,) = (c for c in batch if c[0] == sha and c[4] == v)
            now.pop(sha, None)
            if not change[3]:
                now[sha] = change[:3]
    whole, one, two = (str(tmp_path / n) for n in ("whole", "one", "two"))
    X.build(spark.createDataFrame(list(now.values()), start.schema), whole, buckets=4)
    want = state(spark, whole)

    X.build(start, one, buckets=4)
    for i, batch in enumerate(batches, 1):
        assert X.apply_batch(one, spark.createDataFrame(batch, CHANGE), i)
    assert state(spark, one) == want
    assert X.apply_batch(one, spark.createDataFrame(batches[2], CHANGE), 3)  # run again
    assert state(spark, one) == want
    assert X.compact(spark, one) == 3
    assert state(spark, one) == want
    assert not X.apply_batch(one, spark.createDataFrame(batches[1], CHANGE), 2)  # taken in by the compaction
    assert state(spark, one) == want
    assert X.apply_batch(one, spark.createDataFrame([("t1", "m0", "last words", False, 1)], CHANGE), 4)
    assert [r.token_sha for r in X.search(spark, one, "last").collect()] == ["t1"]

    X.build(start, two, buckets=4)
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, CHANGE).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
        stream = spark.readStream.schema(CHANGE).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        assert X.keep_up(stream, two, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert state(spark, two) == want


def test_a_segment_that_broke_off_is_not_read(spark, index, tmp_path):
    _, rows = index
    path = str(tmp_path / "i")
    X.build(spark.createDataFrame(rows, "token_sha string, module string, content string"), path, buckets=4)
    before = state(spark, path)
    spark.createDataFrame([("lost", "t1", "m0", 1, [0], 2)], "term string, token_sha string, module string, length int, positions array<int>, bucket int").write.partitionBy("bucket").parquet(f"{path}/g0/postings/segment=1")
    spark.createDataFrame([("t1",)], "token_sha string").write.parquet(f"{path}/g0/deleted/segment=1")
    assert state(spark, path) == before


def test_empty_index(spark, tmp_path):
    path = str(tmp_path / "none")
    X.build(spark.createDataFrame([], "token_sha string, module string, content string"), path)
    assert X.search(spark, path, "any words").count() == 0
    with pytest.raises(ValueError):
        X.read(spark, str(tmp_path / "nowhere"))


def test_postings_hold_no_keys_of_tokens(spark, tmp_path):
    """A row per term and block, not per term and token: what a frequent term costs is a number per token."""
    path = str(tmp_path / "i")
    rows = [(f"{i:064d}", "m", f"often rare{i} often") for i in range(200)]
    X.build(spark.createDataFrame(rows, "token_sha string, module string, content string").coalesce(1), path, buckets=2)
    stored = spark.read.parquet(f"{path}/g0/postings")
    assert "token_sha" not in stored.columns
    assert stored.filter("term = 'often'").count() <= 8  # files of the tokens' table
    asked = {(r.token_sha, r.length, tuple(r.positions)) for r in X.read(spark, path, ["often"]).collect()}
    assert asked == {(r[0], 3, (0, 2)) for r in rows}
    everything = sorted(t for i in range(200) for t in ("often", f"rare{i}"))
    assert sorted(r.term for r in X.read(spark, path).collect()) == everything


def test_both_reads_agree(spark, index):
    path, rows = index
    words = sorted({t for _, _, text in rows for t in plain_terms(text)})
    assert sorted(map(str, X.read(spark, path, words).collect())) == sorted(map(str, X.read(spark, path).collect()))
    assert {(r.term, r.token_sha): r.positions for r in X.read(spark, path).collect()} == {
        (t, sha): [i for i, x in enumerate(plain_terms(text)) if x == t] for sha, _, text in rows for t in set(plain_terms(text))
    }


def test_a_whole_read_moves_texts(spark, index):
    """Postings need not be joined with what was deleted, one by one: tokens are, and their terms as one text."""
    plan = X.read(spark, index[0])._jdf.queryExecution().executedPlan().toString()
    assert "places" not in plan and "positions: array" not in plan and "array_join(terms" in plan
