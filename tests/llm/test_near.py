from __future__ import annotations

import itertools
from collections import Counter, defaultdict

import numpy as np

from weftline.llm import groups, near

DOCS = "doc_id long, text string"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, shingles(t or "")) for i, t in rows]
    links = {}
    for a, (i, s) in enumerate(sets):
        links[a] = [b for b, (_, t) in enumerate(sets) if a != b and s and t and len(s & t) >= 0.8 * len(s | t)]
    return links


def classes(links, rows):
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[a], *(root[b] for b in links[a])]) for a in range(len(rows))]
    return root


def test_bands_reach_the_recall():
    b, r = near.bands_for(0.8, 0.999)
    assert b * r <= 160
    assert 1 - (1 - 0.8**r) ** b >= 0.999


def test_against_brute_force(spark, prose):
    rows = []
    for g in range(12):
        words = prose(120, g).split()
        for k in range(g % 5 + 1):
            copy = list(words)
            for j in range(k * 2):
                copy[(j * 37 + k) % 120] = f"new{k}{j}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, t) for i, t in enumerate(["one two", "one two", "ONE  two", "a b c d e", "", None])]
    links = brute(rows)
    got = {r.doc_id: r for r in near.near_classes(spark.createDataFrame(rows, DOCS)).collect()}
    roots = classes(links, rows)
    assert len(got) == len(rows)
    for a, (i, _) in enumerate(rows):
        assert got[i].n_links == len(links[a]), rows[a]
        assert got[i].class_id == rows[roots[a]][0]


def test_a_large_group_is_split_into_blocks(spark, prose):
    words = prose(60, 99).split()
    rows = [(i, " ".join([*words[:30], f"own{i}", *words[30:]])) for i in range(40)]
    got = near.near_classes(spark.createDataFrame(rows, DOCS), block=8).collect()
    links = brute(rows)
    assert {r.doc_id: r.n_links for r in got} == {i: len(links[i]) for i in range(40)}
    assert {r.class_id for r in got} == {0}


def test_overlaps_count_intersections():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 400, 90)).astype(np.uint64) for _ in range(9)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    got = near.overlaps(sets, len(sets), 64)
    np.fill_diagonal(want, 0)
    np.fill_diagonal(got, 0)
    assert (got == want).all()
    assert (near.overlaps(sets, 4, 64) == want[:4, 4:]).all()


def test_components(spark):
    pairs = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), (None, 4), (10, 11), (11, 12), (12, 13), (13, 14), (14, 15)]
    got = groups.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {2: 1, 3: 1, 9: 1, 6: 5, 11: 10, 12: 10, 13: 10, 14: 10, 15: 10}


def test_odd_rows(odd_docs, no_docs):
    got = near.near_classes(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert [r.n_links for r in got if r.doc_id == 1] == [1, 1]
    assert all(r.n_links == 0 and r.class_id == r.doc_id for r in got if r.doc_id in (2, 3, 4))
    assert near.near_classes(no_docs).count() == 0


def test_links_of_the_documents_by_brute_force(spark):
    """Every pair of sf0.01 with Jaccard similarity of 0.8 or more over 5-word shingles is linked, and no other."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets = {}
    for r in rows:
        w = r.text.lower().split() if r.text else []
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    shared = Counter((a, b) for ids in holders.values() for a, b in itertools.combinations(sorted(ids), 2))
    linked = {p for p, n in shared.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    links = Counter(i for p in linked for i in p)
    got = {r.doc_id: r.n_links for r in near.near_classes(spark.createDataFrame(rows)).collect()}
    assert len(linked) > 50
    missed = sum(abs(links[i] - n) for i, n in got.items())
    assert missed <= 2 * len(linked) // 100  # recall of the bands is 0.999 at the threshold


def test_bands_reach_their_recall():
    for threshold in (0.03, 0.1, 0.3, 0.5, 0.8, 0.95, 1.0):
        for recall in (0.9, 0.999):
            bands, rows = near.bands_for(threshold, recall)
            assert 1 - (1 - threshold**rows) ** bands >= recall - 1e-12
            assert rows == 1 or bands * rows <= 160
