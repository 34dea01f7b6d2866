from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa

from weftline.llm import fingerprint as P


def entropy(w):
    return -sum(w.count(b) / len(w) * math.log2(w.count(b) / len(w)) for b in set(w))


def test_entropy_of_every_offset():
    rng = np.random.default_rng(6)
    for data in (b"aab" * 20 + bytes(range(64)), bytes(rng.integers(97, 105, 500, np.uint8)), b"x" * 32, b"x" * 31):
        want = [entropy(data[s : s + P.WINDOW]) for s in range(len(data) - P.WINDOW + 1)]
        assert np.allclose(P._entropies(np.frombuffer(data, np.uint8)), want, atol=1e-5)


def test_selection_by_hand():
    rng = np.random.default_rng(8)
    for sizes in ([300, 3, 0, 90], [P.RUN], [1], [P.RUN + 1, P.RUN - 1, 1]):
        at = np.r_[0, np.cumsum(sizes)]
        key = rng.permutation(int(at[-1])).astype(np.uint64)
        want = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            k = key[a:b].tolist()
            votes = [0] * len(k)
            for i in range(len(k) - P.RUN + 1):
                votes[k.index(max(k[i : i + P.RUN]))] += 1
            want.append({x for x, v in zip(k, votes, strict=True) if len(k) < P.RUN or v >= P.POPULAR})
        keys, before = P._selected(key, at)
        assert [set(keys[a:b].tolist()) for a, b in zip(before[:-1], before[1:], strict=True)] == want


def test_a_shifted_text_without_blanks_is_alike():
    rng = np.random.default_rng(9)
    text = "".join(map(chr, rng.integers(97, 123, 3000)))
    a, b, c = P.filters(pa.array([text, "q" + text, "".join(map(chr, rng.integers(97, 123, 3000)))]))
    assert P.likeness(a, b) > 0.9
    assert P.likeness(a, c) < 0.1


def test_likeness(prose):
    texts = [prose(400, 1), prose(400, 1) + " end", prose(400, 2), "", "", "short", "short", prose(5000, 3), prose(3700, 3)]
    c = P.filters(pa.array(texts))
    assert P.likeness(c[0], c[0]) == 1.0
    assert P.likeness(c[0], c[1]) > 0.9
    assert P.likeness(c[0], c[2]) < 0.1
    assert P.likeness(c[3], c[4]) == 1.0
    assert P.likeness(c[3], c[0]) == 0.0
    assert P.likeness(c[5], c[6]) == 1.0
    assert len(c[7]) > 1
    assert P.likeness(c[7], c[8]) > 0.5


def test_order_edits_and_odd_rows(spark, odd_docs, no_docs, prose):
    rows = [(i * 7 % 50, prose(20 + i, i)) for i in range(50)]
    got = {r.doc_id: r for r in P.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    texts = dict(rows)
    for i in range(50):
        t, n = texts[i], texts[(i + 1) % 50]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + n[:cut]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        chains = P.filters(pa.array([t, edited, n]))
        assert got[i].fingerprint == P.text_of(chains[0])
        assert got[i].edited_fingerprint == P.text_of(chains[1])
        assert (got[i].near_edited, got[i].near_next) == (P.likeness(chains[0], chains[1]), P.likeness(chains[0], chains[2]))
    odd = P.fingerprints(odd_docs).collect()
    assert len(odd) == odd_docs.count()
    assert len({r.fingerprint for r in odd if r.doc_id == 1}) == 1
    assert {r.fingerprint for r in odd if r.doc_id in (2, 3)} == {""}
    assert P.fingerprints(no_docs).count() == 0
    alone = P.fingerprints(spark.createDataFrame([(1, "abcd efgh")], "doc_id long, text string")).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest()
