"""Language ID and quality: brute force, held-out accuracy and odd rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weftline.llm import bytetext as B
from weftline.llm import langid, pieces, quality
from weftline.llm import queries as Q

SF = "/root/testdata/sf0.01"


def test_forward_sums_all_segmentations():
    p = pieces.load(pieces.default_path())
    rng = np.random.default_rng(1)
    table = rng.random((len(p.ids), 2)) / 100
    place = {p.texts[i]: k for k, i in enumerate(p.ids.tolist())}
    for word in ("▁the", "▁ation", "▁schö", "▁ŷx"):
        def total(rest, lang):
            if not rest:
                return 1.0
            out = 0.0
            for k in range(1, len(rest) + 1):
                if rest[:k] in place:
                    out += table[place[rest[:k]], lang] * total(rest[k:], lang)
                elif k == 1:
                    out += langid.FLOOR * total(rest[k:], lang)
            return out

        data, at = pieces.codes([word])
        grams = pieces.substrings(p, pieces.matrix(data, at[:-1], len(word)))
        got = langid._forward(grams, len(word), langid._padded(table))[-1][0]
        assert np.allclose(got, [total(word, 0), total(word, 1)], rtol=1e-9)


def test_language_accuracy_held_out(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = Q.op9_language_id(spark, SF).join(truth, "doc_id")
    row = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert row.right > 0.98
    assert 0 <= row.low <= row.high <= 1


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    model = langid.fit(odd_docs)
    assert model.languages == ("de", "en", "fr")
    got = langid.identify(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters)
        assert r.predicted == 1  # other columns stay
    none = langid.fit(no_docs)
    assert none.languages == ()
    assert {r.lang_pred for r in langid.identify(odd_docs, none).collect()} == {"und"}
    assert langid.identify(no_docs, model).count() == 0


def test_long_runs_of_letters_stay_whole():
    data, at = pieces.codes(["a" * 60 + " b1c", ""])
    start, end, first = langid._word_spans(data, at)
    assert (end - start).tolist() == [60, 1, 1]
    assert first.tolist() == [0, 3, 3]


def segmentations(word, p):
    """Every cut of a word into pieces, letters that no piece covers among them (place -1)."""
    if not word:
        yield []
    for k in range(1, min(len(word), p.longest) + 1):
        data, at = pieces.codes([word[:k]])
        place = int(p.find(B.spans(pieces.code_sums(data), at[:-1], at[1:]))[0])
        if place >= 0 or k == 1:
            for rest in segmentations(word[k:], p):
                yield [place, *rest]


def test_sums_and_expected_counts_by_all_segmentations(monkeypatch):
    path = pieces.default_path()
    p = pieces.load(path)
    prob = np.random.default_rng(3).dirichlet(np.full(len(p.ids), 0.3), 2).T + 1e-9
    words = ["the", "streams", "ßaß", "ꙮx", "schule"]
    want, total = np.zeros((len(p.ids) + 1, 2)), []
    for i, w in enumerate(words):
        ways = [*segmentations("\u2581" + w, p)]
        weight = [math.prod(prob[j, i % 2] if j >= 0 else langid.FLOOR for j in way) for way in ways]
        total.append(math.log(sum(weight)))
        for way, x in zip(ways, weight, strict=True):
            for j in way:
                want[j, i % 2] += (i + 1) * x / sum(weight)
    for long in (24, 2):  # by sums, then by their logs
        monkeypatch.setattr(langid, "LONG", long)
        monkeypatch.setattr(langid, "SPAN", 3 if long == 2 else 4096)
        batch = pa.RecordBatch.from_arrays([pa.array([i % 2 for i in range(5)], pa.int32()), pa.array(words), pa.array(range(1, 6), pa.int64())], ["number", "word", "n"])
        (got,) = langid._expected(path, prob)(iter([batch]))
        counts = np.zeros_like(want[:-1])
        counts[got.column("piece").to_numpy(), got.column("number").to_numpy()] = got.column("n").to_numpy()
        assert np.allclose(counts, want[:-1])
        (rated,) = langid._score(path, ("a", "b"), prob, np.array([0.3, 0.7]), False)(iter([pa.RecordBatch.from_arrays([pa.array(words)], ["text"])]))
        for i, w in enumerate(words):
            a, b = (math.log(prior) + math.log(sum(math.prod(prob[j, c] if j >= 0 else langid.FLOOR for j in way) for way in segmentations("\u2581" + w, p))) for c, prior in ((0, 0.3), (1, 0.7)))
            assert rated.column("lang_pred")[i].as_py() == ("a" if a >= b else "b")
            assert math.isclose(rated.column("score")[i].as_py(), 1 / (1 + math.exp(-abs(a - b))), rel_tol=1e-4)
            assert math.isclose((a, b)[i % 2] - math.log((0.3, 0.7)[i % 2]), total[i], rel_tol=1e-9)


def test_a_word_of_thousands_of_letters():
    path = pieces.default_path()
    n = len(pieces.load(path).ids)
    prob = np.full((n, 2), 1 / n)
    prob[:, 1] = np.linspace(1, 2, n)
    prob /= prob.sum(axis=0)
    text = "abcdefghij" * 900
    (rated,) = langid._score(path, ("a", "b"), prob, np.full(2, 0.5), False)(iter([pa.RecordBatch.from_arrays([pa.array([text, text + text[:1]])], ["text"])]))
    assert 0.5 <= rated.column("score")[0].as_py() <= 1


def test_bradley_terry_minimises_its_loss():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(0.5, 1, (60, 3)), rng.normal(0, 1, (50, 3))
    w = quality.bradley_terry(good, bad, pairs=500)
    chosen = np.random.default_rng(1)
    d = good[chosen.integers(60, size=500)] - bad[chosen.integers(50, size=500)]
    loss = lambda v: np.log1p(np.exp(-d @ v)).mean() + 1e-3 * v @ v / 2
    assert all(loss(w) <= loss(w + rng.normal(0, 0.05, 3)) for _ in range(50))


def test_features_by_hand():
    x = dict(zip(quality.FEATURES, quality.features(pa.array(["Aa bb!! | cc cc.\ndd%%%"]))[0] ** 2, strict=True))
    assert math.isclose(x["bang_ends"], 1 / 6)
    assert math.isclose(x["bars"], 1 / 6)
    assert math.isclose(x["symbol_ends"], 1 / 6)
    assert math.isclose(x["upper"], 1 / 10)
    assert quality.features(pa.array(["a a a b", None, ""]))[:, 7].tolist() == [math.sqrt(0.5), 0, 0]


def test_quality_accuracy_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = Q.op3_quality_classifier(spark, SF).join(labels, "doc_id").filter("held_out")
    row = got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int")).alias("right"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert row.right > 0.95
    assert 0 <= row.low <= row.high <= 1


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (8, 0), (5, None), (None, 1), (99, 0)], "doc_id long, quality int")
    model = quality.fit(odd_docs, labels)
    got = quality.rate(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    assert all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3, 4)}) <= 2
    one_sided = quality.fit(odd_docs, labels.filter("quality = 1"))
    assert {r.score for r in quality.rate(odd_docs, one_sided).collect()} == {1.0}
    assert quality.rate(no_docs, model).count() == 0


def test_every_language_is_learned(spark):
    rows = [(100 * k + i, " ".join(chr(97 + k // 26) * 2 + chr(97 + k % 26) * 2 for _ in range(6)), f"l{k:02}") for k in range(70) for i in range(2 + (k > 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.languages) == 70
    got = langid.identify(docs, model).collect()
    assert all(r.lang == r.lang_pred for r in got)
    whole = langid.LanguageModel(model.path, model.languages, (np.concatenate(model.probability, axis=1),), model.prior)
    small = langid.LanguageModel(model.path, model.languages, tuple(np.split(whole.probability[0], [9, 25, 40, 41, 60], axis=1)), model.prior)
    odd = spark.createDataFrame([(1, "aabb ccaa"), (2, ""), (3, None), (4, "aaaa")], "doc_id long, text string")
    for frame in (docs.limit(40), odd):
        a, b = (sorted((r.doc_id, r.lang_pred, r.score) for r in langid.identify(frame, m).collect()) for m in (whole, small))
        assert [x[:2] for x in a] == [x[:2] for x in b]
        assert np.allclose([x[2] for x in a], [x[2] for x in b], rtol=1e-6)


def test_language_keeps_a_column_of_its_own_name(spark):
    docs = spark.createDataFrame([(1, "plain words", "en", 7), (2, "einfache Wörter", "de", 8)], "doc_id long, text string, lang string, _Lang_Top int")
    got = langid.identify(docs, langid.fit(docs))
    assert got.columns == ["doc_id", "text", "lang", "_Lang_Top", "lang_pred", "score"]
    assert sorted((r.doc_id, r._Lang_Top) for r in got.collect()) == [(1, 7), (2, 8)]


def test_every_label_teaches(spark, monkeypatch):
    """All labelled rows are in a pair, in small blocks too and where one class is rare; the cut is an order statistic of all of them."""
    monkeypatch.setattr(quality, "BLOCK", 16)
    for rare in (5, 60):
        rows = spark.createDataFrame([(i, int(i >= rare), [float(i) * (1000 if i >= rare else 1)]) for i in range(200 + rare)], "doc_id long, label int, x array<double>")
        d = [int(r.d[0]) for r in quality._pairs(rows, 200, rare).collect()]
        assert {-(-v // 1000) for v in d} == {*range(rare, 200 + rare)} and {-v % 1000 for v in d} == {*range(rare)}
    values = spark.createDataFrame([(float(v % 97) / 7,) for v in range(3000)], "s double")
    want = sorted(float(v % 97) / 7 for v in range(3000))
    assert [quality._ranked(values, k, bins=8) for k in (0, 1, 1499, 2999)] == [want[k] for k in (0, 1, 1499, 2999)]
    d = np.random.default_rng(3).normal(0.4, 1, (500, 3))
    w = quality._weights(spark.createDataFrame([(list(map(float, x)),) for x in d], "d array<double>"), 3)
    p = 1 / (1 + np.exp(d @ w))
    assert np.abs(1e-3 * w - d.T @ p / len(d)).max() < 1e-6
