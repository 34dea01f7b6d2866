"""Packing, encoding, decoding and counting."""

from __future__ import annotations

import itertools
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import memo, packing, pieces, pretokens, viterbi

PATH = pieces.default_path()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def strange(n, seed):
    rng = random.Random(seed)
    letters = [*" \n\t'sremvldab  ", *"É中٣١½ß😀.,!?-—\x00\x85 ▁", "'s", "'ll", "'re", "<|endoftext|>", "the", " and"]
    return ["".join(rng.choices(letters, k=rng.randrange(30))) for _ in range(n)] + ["", None, "'", "a's", "I'll've", "  x", "x  "]


def test_pretokens_give_the_tokenizers_ids(tokenizer):
    texts = strange(4000, 1)
    ids, at = pretokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), most=256).encode(pa.array(texts))
    for i, e in enumerate(tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids, texts[i]


def test_stores_fill_over_many_batches(tokenizer):
    """Up to the limit, just past it and past it twice: ids and counts stay those of a store that forgets nothing."""
    for store in (memo.Memo(16), memo.Memo(512), memo.Memo(1000)):
        assert store.room(store.most)
        assert not store.room(store.most + 1)
    texts = [f"w{i} q{i * 7919 % 100003}x" for i in range(5000)]
    encoder, low = pretokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), most=1024), viterbi.MOST_WORDS
    viterbi.MOST_WORDS = 1024
    viterbi._held.clear()
    try:
        for a in range(0, len(texts), 100):
            some = texts[a : a + 100]
            ids, at = encoder.encode(pa.array(some))
            assert [ids[b:c].tolist() for b, c in itertools.pairwise(at)] == [e.ids for e in tokenizer.encode_batch(some, add_special_tokens=False)]
            ids, at = viterbi.encode(pa.array(some), PATH)
            data, start, end, first = viterbi.words(pa.array(some), PATH)
            p = pieces.load(PATH)
            held, rows = viterbi._known("count", PATH, data, start, end, lambda x, y, data=data, p=p: (viterbi.trie_counts(p, data, x, y), np.ones(len(x), np.int64)))
            total = np.r_[0, np.cumsum(held.values[held.at[rows]], dtype=np.int64)][first]
            assert np.diff(total).tolist() == np.diff(at).tolist()
            assert viterbi.decode(ids, at, PATH).to_pylist() == some
    finally:
        viterbi.MOST_WORDS = low
        viterbi._held.clear()


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        price = np.full(31, -1.0)
        kinds = rng.choice(np.arange(2, 31), 6, replace=False)
        price[kinds] = rng.random(6)
        best = [0.0] * 31
        for c in range(1, 31):
            best[c] = max([best[c - 1], *(best[c - k] + price[k] for k in kinds if k <= c)])
        got = packing.knapsack(price, int(kinds.min()), 30)
        assert sum(got) <= 30
        assert abs(sum(price[k] for k in got) - best[30]) < 1e-9


def test_plans_cover_the_histogram():
    rng = np.random.default_rng(4)
    for n in (0, 1, 50, 20_000):
        counts = np.bincount(np.minimum(2048, np.exp(rng.normal(6, 1, n)).astype(int) + 1), minlength=2049)
        plan = packing.solve(counts, rounds=60)
        made = Counter()
        for config, times in plan:
            assert sum(config) <= 2048
            for length in config:
                made[length] += times
        assert made == Counter({i: int(c) for i, c in enumerate(counts) if c})
        least = -(-int((counts * np.arange(2049)).sum()) // 2048)
        assert sum(t for _, t in plan) <= least + 2 + least // 500


def test_packing(spark, odd_docs, no_docs, tokenizer):
    rows = [(i, t) for i, t in enumerate(strange(300, 5))] + [(1000, "lorem " * 5000), (1001, "lorem " * 2047), (1002, "lorem " * 2048)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), rounds=30).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // 2048)))
        assert all(r.length == 2048 for r in mine[1:])
        for r in mine:
            part = ids[r.start : r.start + r.length]
            assert len(part) == r.length
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        assert sum(r.length for r in mine) == len(ids)
    for mine in by_sequence.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    odd = packing.pack(odd_docs, rounds=5).collect()
    assert sum(r.piece == 0 for r in odd) == odd_docs.count()
    assert len({(r.sequence_id, r.offset) for r in odd}) == len(odd)
    assert packing.pack(no_docs, rounds=5).count() == 0


def brute(text):
    p = pieces.load(PATH)
    known = {p.texts[i]: (s, [i]) for i, s in zip(p.ids.tolist(), p.scores.tolist(), strict=True)}
    worst = p.scores.min() - viterbi.UNKNOWN
    units = ["▁", *("\ud800" if c == "▁" else "▁" if c == " " else c for c in text)] if text else []
    best = [(0.0, [])]
    for e in range(1, len(units) + 1):
        top = None
        for k in range(1, min(e, p.longest) + 1):
            piece = "".join(units[e - k : e])
            if piece in known:
                s, ids = known[piece]
            elif k == 1:
                s, ids = worst, p.byte_ids[list(("▁" if piece == "\ud800" else piece).encode())].tolist()
            else:
                continue
            if top is None or best[e - k][0] + s >= top[0]:
                top = (best[e - k][0] + s, best[e - k][1] + ids)
        best.append(top)
    return best[-1][1]


def test_viterbi_against_brute_force_and_back():
    texts = strange(1500, 7)
    ids, at = viterbi.encode(pa.array(texts), PATH)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == brute(t or "")
    assert viterbi.decode(ids, at, PATH).to_pylist() == [t or "" for t in texts]


def test_trie_counts_equal_the_encoders():
    data, start, end, _ = viterbi.words(pa.array(strange(1500, 8)), PATH)
    p = pieces.load(PATH)
    _, counts = viterbi._segmented(p, data)(start, end)
    assert viterbi.trie_counts(p, data, start, end).tolist() == counts.tolist()


def test_spark_round_trip_and_odd_rows(odd_docs, no_docs):
    coded = viterbi.decode_texts(viterbi.encode_texts(odd_docs)).withColumn("same", F.col("decoded").eqNullSafe(F.col("text")))
    counted = viterbi.count_tokens(coded).collect()
    assert len(counted) == odd_docs.count()
    assert all(r.same for r in counted)
    assert all(r.n_tokens == len(r.ids or []) for r in counted)
    assert all(r.key == 1 for r in counted)
    assert viterbi.count_tokens(viterbi.encode_texts(no_docs)).count() == 0
