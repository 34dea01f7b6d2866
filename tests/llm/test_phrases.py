"""Phrase mining against a plain count, with narrow sketches and small blocks, and odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from weftline.llm import phrases as P

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, percent=100, most=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    f = {k: v for k, v in f.items() if v >= least}
    out = []
    for (lang, w), a in f.items():
        if len(w) < 2:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        longer = [v for (other, x), v in f.items() if other == lang and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x)))]
        if all(100 * v < percent * a for v in longer):
            out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    rank, ranked = Counter(), []
    for lang, score, a, phrase, left, right, total in sorted(out):
        rank[lang] += 1
        if rank[lang] <= most:
            ranked.append((lang, rank[lang], phrase.decode(), -a, left, right, total, -score))
    return sorted(ranked)


def texts(n, seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "😀", "new", "york", "a\x00b", "c++", " ", "ÉA", "(x)"]
    made = []
    for _ in range(n):
        made.append((rng.choice(["en", "de", None, "und"]), "".join(rng.choice([*words, "new york", "of the new york"]) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "\x0b", ", ", "-", " "]) for _ in range(rng.randrange(40)))))
    return made


@pytest.mark.parametrize("narrow", [False, True])
def test_by_brute_force(spark, monkeypatch, narrow):
    if narrow:  # sketches that tell little, many blocks and shards, slices of few texts
        for name, value in (("MOST_BITS", 5), ("AUTOMATON", 7), ("SHARD_BYTES", 900), ("SLICE", 300), ("MOST_LANGUAGES", 1)):
            monkeypatch.setattr(P, name, value)
    rows = [*texts(300, 5), ("en", None), ("en", ""), (None, " .\t"), ("fr", "word " * 3000), ("fr", "x" * 50_000)]
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("lang", "text", "1 as n", "'z' as phrase", "2 as kind")
    for least, percent, most in ((8, 100, 2000), (3, 60, 5)):
        got = P.collocations(docs, least=least, percent=percent, most=most)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == plain(rows, least, percent, most)


def test_thresholds_beyond_a_byte(spark):
    rows = [("en", "big apple here")] * 299 + [("en", "big apple")] * 2 + [("en", "apple here")] * 900
    docs = spark.createDataFrame(rows, "lang string, text string")
    for least in (300, 301, 1199):
        assert sorted(map(tuple, P.collocations(docs, least=least).collect())) == plain(rows, least)


def test_arithmetic_beyond_64_bits(spark):
    a, left, right, n = 3 * 10**11 + 7, 10**12 + 1, 9 * 10**11 + 3, 10**14 + 9
    phrases = spark.createDataFrame([("en", "x y", a), ("en", "x", left), ("en", "y", right)], "lang string, phrase string, f long")
    (row,) = P.scored(phrases, spark.createDataFrame([("en", n)], "lang string, n long")).collect()
    assert tuple(row) == ("en", "x y", a, left, right, n, 1000 * a * n // (left * right))


def test_empty_table(spark):
    assert P.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
