"""Toxicity: terms by a plain loop, label model on drawn votes, loss, held-out documents and odd rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from weftline.llm import queries as Q
from weftline.llm import toxicity as X

SF = "/root/testdata/sf0.1"


def test_terms_by_a_plain_loop():
    texts = ["An idiot, and an IDIOT2!", None, "", "Ünder überall ab", "名前は x", "1 2 !"]
    hashes, of, whole, words = X.terms(pa.array(texts))
    want = []
    for i, t in enumerate(texts):
        for run in regex.findall(r"[぀-鿿]+|(?:(?![぀-鿿])\p{L})+", (t or "").lower()):
            if run[0] > "　":
                want += [(i, run[j : j + k]) for j in range(len(run)) for k in X.LETTERS if j + k <= len(run)]
            else:
                want += [(i, run[:k]) for k in X.BEGINNINGS if k <= len(run)]
                want += [(i, run, "whole")] if len(run) >= 3 else []
    assert len(want) == len(hashes)
    assert sum(whole) == sum(len(w) == 3 for w in want)
    assert np.bincount(of, minlength=6).tolist() == np.bincount([w[0] for w in want], minlength=6).tolist()
    known = {}  # the same word or beginning has one hash, others have others
    for i, w, *r in want:
        if w[0] < "　":
            known[w, *r] = int(X.terms(pa.array([w]))[0][0 if r else -1])
    assert len({*known.values()}) == len(known)
    latin = of != 4
    assert sorted((int(o), int(h)) for o, h in zip(of[latin], hashes[latin], strict=True)) == sorted((i, known[w, *r]) for i, w, *r in want if i != 4)
    assert words.tolist() == [5, 0, 0, 3, 4, 0]


def test_label_model_finds_accuracies_and_pairs():
    rng = np.random.default_rng(4)
    n = 20_000
    y = rng.random(n) < 0.2
    drawn = np.zeros((n, 6), np.int8)
    right = [0.9, 0.8, 0.7, 0.75, 0.85]
    for j, p in enumerate(right):
        drawn[:, j] = np.where((rng.random(n) < p) == y, 1, -1)
    drawn[:, 5] = np.where(rng.random(n) < 0.9, drawn[:, 4], -drawn[:, 4])  # mostly a copy
    drawn[rng.random(n) < 0.3, 3] = 0
    patterns, back, times = np.unique(drawn, axis=0, return_inverse=True, return_counts=True)
    post, accuracy, pairs = X.label_model(patterns, times.astype(float))
    assert [(j, k) for j, k, _ in pairs][:1] == [(4, 5)]
    assert all(abs(a - b) < 0.03 for a, b in zip(accuracy, right, strict=False))
    assert ((post[back.ravel()] > 0.5) == y).mean() > 0.93


def test_logistic_minimises_its_loss(monkeypatch):
    rng = np.random.default_rng(6)
    row, column = np.repeat(np.arange(200), 5), rng.integers(0, 20, 1000)
    value, target, weight = rng.random(1000), rng.random(200), rng.random(200)

    def loss(w, b):
        z = np.bincount(row, value * w[column], 200) + b
        return (weight / weight.sum() * (np.logaddexp(0, z) - target * z)).sum() + X.PENALTY * (w * w).sum() / 2

    w, b = X.logistic(row, column, value, target, weight, 20)
    best = loss(w, b)
    for _ in range(50):
        assert loss(w + rng.normal(0, 0.05, 20), b + rng.normal(0, 0.05)) > best


def test_held_out_documents(spark):
    truth = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    got = Q.op12_toxicity(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.join(truth, "doc_id").filter("held_out").select("toxic", "predicted", "score").collect()
    toxic = [r.predicted for r in rows if r.toxic]
    assert sum(toxic) / len(toxic) > 0.85  # some labels stand on texts without abuse
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.002 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark, odd_docs, no_docs):
    bad = [(100 + i, f"you are a worthless {w} and a clown {i}", 1) for i in range(30) for w in ["moron"]]
    good = [(200 + i, f"a kind {w} with some friends {i}", 0) for i in range(60) for w in ["walk"]]
    labels = spark.createDataFrame([*[(i, y) for i, _, y in bad + good], (3, 0), (None, 1), (2, None), (4, 7)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in bad + good], "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    model = X.fit(docs, labels)
    got = X.rate(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(r.rank == 1 and 0 <= r.score < 0.5 and r.predicted == 0 for r in got)
    said = X.rate(spark.createDataFrame([("what a worthless MORON, that clown",), ("a kind walk",)], "text string"), model).collect()
    assert [r.predicted for r in said] == [1, 0]
    assert X.rate(no_docs, model).count() == 0
    one = X.fit(docs, labels.filter("toxic = 1"))
    assert X.rate(docs, one).filter("predicted = 0").count() == 0
    assert X.rate(docs, X.fit(docs, labels.filter("false"))).agg(F.max("score")).first()[0] < 1e-6
    assert X.rate(docs, X.fit(no_docs, labels)).filter("predicted = 1").count() == 0


@pytest.mark.parametrize("text,name,vote", [("I'll kill you", "threat", 1), ("You are such a total clown", "address", 1), ("f**k", "masked", 1), ("no!!", "bangs", 1), ("danke", "courtesy", -1), ("THIS IS ALL SHOUTED AT YOU", "shouting", 1), ("Idiota", "spanish", 1), ("idiots", "minds", 1)])
def test_voters(text, name, vote):
    got = X.votes(pa.array([text, "plain words"]), np.array([0, 1]), np.zeros(2, np.int32), {})
    assert got[:, X.VOTERS.index(name)].tolist() == [vote, 0]
    assert got[:, 0].tolist() == [-1, 1]
    assert math.isclose(np.abs(got[:, [X.VOTERS.index(v) for v in X.LEARNED]]).sum(), 0)
