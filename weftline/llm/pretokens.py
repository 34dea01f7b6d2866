"""Pre-tokens of a byte-level BPE found by array operations, and a memo of their ids.

The split is that of the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
Runs of letters, numbers, white space and other characters are found for all texts at once. A run's last
blank goes to the next run of the same text, and a lone apostrophe takes a contraction's letters.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from weftline.llm import bytetext as B
from weftline.llm import pieces as P
from weftline.llm.memo import Memo

CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[ord(m[0][0])] = kind
            a, b = ord(m[0][0]), ord(m[0][-1])
            if b - a == len(m[0]) - 1:
                out[a : b + 1] = kind
            else:  # the run leaps over the surrogates
                out[[ord(c) for c in m[0]]] = kind
    return out


def split(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Starts of all pre-tokens of the texts whose code points are ``data`` and whose bounds are ``at``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = _kinds()[data]
    edge = np.zeros(n + 1, bool)
    edge[0] = edge[n] = True
    edge[1:n] = kind[1:] != kind[:-1]
    bound = np.zeros(n + 1, bool)
    bound[at] = True
    edge |= bound
    run = np.flatnonzero(edge[:-1])
    # white space before another run of the same text: its last character starts a token, which goes on if it is a blank
    next_run = np.flatnonzero(edge[1:]) + 1  # the end of each run
    space = (kind[run] == _SPACE) & ~bound[next_run]
    last = next_run[space] - 1
    edge[last] = True
    blank = data[last] == 32
    edge[last[blank] + 1] = False
    # a lone apostrophe with letters behind it and no blank before it
    quote = run[(data[run] == 39) & (next_run - run == 1)]
    quote = quote[edge[quote]]
    quote = quote[(quote + 1 < n) & ~bound[np.minimum(quote + 1, n)]]
    quote = quote[kind[quote + 1] == _LETTER]
    if len(quote):
        end = next_run[np.searchsorted(run, quote + 1)]
        left = np.ones(len(quote), bool)
        for letters in CONTRACTIONS:
            fits = left & (end - quote - 1 >= len(letters))
            for i, c in enumerate(letters):
                fits[fits] = data[quote[fits] + 1 + i] == ord(c)
            left &= ~fits
            edge[quote[fits] + 1] = False
            edge[quote[fits] + 1 + len(letters)] = True
    return np.flatnonzero(edge[:-1])


class Encoder:
    """Token ids of texts by a tokenizer file, each distinct pre-token encoded once and kept.

    Texts that hold one of the file's added tokens (as ``<|endoftext|>``) go to the tokenizer as a whole.
    """

    def __init__(self, path: str, most: int = 1 << 19):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        added = sorted(t.content for t in self._tokenizer.get_added_tokens_decoder().values())
        self._added = "|".join(map(regex.escape, added))
        self._most = most
        self._clear(most)

    def _clear(self, most: int) -> None:
        self._memo = Memo(most)
        self._ids = np.zeros(1 << 16, np.uint32)
        self._at = np.zeros(self._memo.most + 1, np.int64)

    def _take(self, hashes: np.ndarray, texts: list[str]) -> None:
        got = [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        used = self._at[self._memo.size]
        ends = used + np.cumsum([len(x) for x in got])
        if ends[-1] > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros(max(len(self._ids), int(ends[-1])), np.uint32)])
        self._ids[used : ends[-1]] = np.fromiter((i for x in got for i in x), np.uint32, int(ends[-1] - used))
        self._at[self._memo.size + 1 : self._memo.size + 1 + len(got)] = ends
        self._memo.add(hashes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids behind one another, and the n + 1 places where each text's begin; null counts as empty."""
        marked = pc.fill_null(pc.match_substring_regex(texts, self._added), False) if self._added else None
        if marked is None or not pc.any(marked, min_count=0).as_py():
            return self._plain(texts)
        ids, at = self._plain(pc.if_else(marked, "", texts))
        where = np.flatnonzero(marked.to_numpy(zero_copy_only=False))
        got = [e.ids for e in self._tokenizer.encode_batch_fast(texts.filter(marked).to_pylist(), add_special_tokens=False)]
        counts = np.zeros(len(texts), np.int64)
        counts[where] = [len(x) for x in got]
        ids = np.insert(ids, np.repeat(at[where], counts[where]), np.fromiter((i for x in got for i in x), np.uint32, int(counts.sum())))
        return ids, at + np.r_[0, np.cumsum(counts)]

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at = P.column_codes(texts)
        start = split(data, at)
        end = np.r_[start[1:], len(data)]
        hashes = B.spans(P.code_sums(data), start, end)
        rows = self._memo.find(hashes)
        fresh = np.flatnonzero(rows < 0)
        if len(fresh):
            new, first = np.unique(hashes[fresh], return_index=True)
            if not self._memo.room(len(new)):
                new, first = np.unique(hashes, return_index=True)
                fresh = np.arange(len(hashes))
                self._clear(max(self._most, len(new)))
            text = data.tobytes().decode("utf-32-le")
            where = fresh[first]
            self._take(new, [text[a:b] for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)])
            rows[fresh] = self._memo.find(hashes[fresh])
        count = self._at[rows + 1] - self._at[rows]
        ids = self._ids[B.runs(self._at[rows], count)]
        return ids, np.r_[0, np.cumsum(count)][np.searchsorted(start, at)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's one encoder for ``path``."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
