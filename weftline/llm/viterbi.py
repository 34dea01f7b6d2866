"""Unigram Viterbi over a public SentencePiece vocabulary: encoding, decoding and token counts.

A text begins with a blank, blanks become U+2581, and a character that no piece covers becomes byte pieces
(a literal U+2581 too, so that decoding gives the text back). The best segmentation has the greatest sum of
the model's piece scores; a character in byte pieces costs UNKNOWN more than the worst piece; of equal sums the
one with the longer last piece wins. Texts are split into words where no piece can reach across.

Encoding advances equal-length words together; counting puts words into a trie and does each
shared prefix once. Both keep what they have found for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftline.llm import bytetext as B
from weftline.llm import pieces as P
from weftline.llm.memo import Memo
from weftline.llm.session import mapped

UNKNOWN = 10.0
LITERAL = 0xD800  # a surrogate, which no text has, stands for a literal U+2581
MOST_WORDS = 1 << 19
CELLS = 1 << 18  # places of equal-length words that advance together


@lru_cache(maxsize=2)
def _joins(path: str) -> np.ndarray:
    """Whether each code point stands in a piece of several characters."""
    pieces = P.load(path)
    out = np.zeros(0x110000, bool)
    out[list({ord(c) for i in pieces.ids.tolist() if len(pieces.texts[i]) > 1 for c in pieces.texts[i]})] = True
    return out


@lru_cache(maxsize=2)
def _blank_inside(path: str) -> bool:
    """Whether a piece has a blank behind another character, so that words can't be split before blanks."""
    pieces = P.load(path)
    return any("▁" in pieces.texts[i].lstrip("▁") for i in pieces.ids.tolist())


def words(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points as pieces see them, start and end of all words, and the number of words before each text. Empty texts have none."""
    plain, at = P.column_codes(texts)
    full = np.diff(at) > 0
    data = np.where(plain == P.SPACE, np.uint32(LITERAL), np.where(plain == 32, np.uint32(P.SPACE), plain))
    data = np.insert(data, at[:-1][full], P.SPACE)
    at = at + np.r_[0, np.cumsum(full)]
    n = len(data)
    if not n:
        return data, at[:0], at[:0], np.zeros(len(at), np.int64)
    joins = _joins(path)[data]
    edge = np.zeros(n + 1, bool)
    edge[1:n] = ~(joins[1:] & joins[:-1])
    if not _blank_inside(path):
        blank = data == P.SPACE
        edge[1:n] |= blank[1:] & ~blank[:-1]
    edge[at] = True
    marks = np.flatnonzero(edge)
    return data, marks[:-1], marks[1:], np.searchsorted(marks[:-1], at)


def _byte_count(codes: np.ndarray) -> np.ndarray:
    codes = np.where(codes == LITERAL, P.SPACE, codes)
    return 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF).astype(np.int64)


class _Held:
    """What is known of words: ``values`` behind one another and where each word's begin."""

    def __init__(self, most: int):
        self.memo, self.values = Memo(most), np.zeros(1 << 16, np.int32)
        self.at = np.zeros(self.memo.most + 1, np.int64)

    def take(self, hashes: np.ndarray, values: np.ndarray, counts: np.ndarray) -> None:
        size, used = self.memo.size, self.at[self.memo.size]
        need = int(used) + len(values)
        if need > len(self.values):
            self.values = np.concatenate([self.values, np.zeros(max(len(self.values), need), np.int32)])
        self.values[used:need] = values
        self.at[size + 1 : size + 1 + len(counts)] = used + np.cumsum(counts)
        self.memo.add(hashes)


_held: dict[tuple[str, str], _Held] = {}


def _known(kind: str, path: str, data: np.ndarray, start: np.ndarray, end: np.ndarray, work) -> tuple[_Held, np.ndarray]:
    """The worker's store and the place of each word in it; ``work(start, end)`` gives values and counts of new words."""
    hashes = B.spans(P.code_sums(data), start, end)
    held = _held.setdefault((kind, path), _Held(MOST_WORDS))
    rows = held.memo.find(hashes)
    fresh = np.flatnonzero(rows < 0)
    if len(fresh):
        new, first = np.unique(hashes[fresh], return_index=True)
        if not held.memo.room(len(new)):
            new, first = np.unique(hashes, return_index=True)
            fresh = np.arange(len(hashes))
            held = _held[kind, path] = _Held(max(MOST_WORDS, len(new)))
        where = fresh[first]
        held.take(new, *work(start[where], end[where]))
        rows[fresh] = held.memo.find(hashes[fresh])
    return held, rows


def segment(pieces: P.Pieces, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the best segmentations of equal-length words behind one another, and the number of each word's."""
    n, length = rows.shape
    grams = P.substrings(pieces, rows)
    scores = np.r_[pieces.scores, -np.inf]
    worst = pieces.scores.min() - UNKNOWN
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((n, length + 1), np.int32)
    for end in range(1, length + 1):
        for k in range(1, min(end, len(grams)) + 1):
            piece = grams[k - 1][:, end - k]
            total = best[:, end - k] + (np.where(piece < 0, worst, scores[piece]) if k == 1 else scores[piece])
            better = total >= best[:, end]
            best[better, end] = total[better]
            back[better, end] = k
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # word, its step from the end, id
    at, row, step = np.full(n, length), np.arange(n), 0
    while len(row):
        k = back[row, at]
        piece = np.full(len(row), -1, np.int32)
        for size in np.unique(k):
            some = k == size
            piece[some] = grams[size - 1][row[some], at[some] - size]
        known = piece >= 0
        out.append((row[known], np.full(known.sum(), step), pieces.ids[piece[known]]))
        for i in np.flatnonzero(~known):
            code = int(rows[row[i], at[i] - 1])
            units = chr(P.SPACE if code == LITERAL else code).encode()
            out.append((np.full(len(units), row[i]), step + np.arange(len(units))[::-1] / 8, pieces.byte_ids[list(units)]))
        at = at - k
        row, at = row[at > 0], at[at > 0]
        step += 1
    word, steps, ids = (np.concatenate(x) for x in zip(*out, strict=True))
    return ids[np.lexsort((-steps, word))], np.bincount(word, minlength=n)


def _segmented(pieces: P.Pieces, data: np.ndarray):
    def work(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = end - start
        counts = np.zeros(len(start), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for size in np.unique(length):
            same = np.flatnonzero(length == size)
            for a in range(0, len(same), max(1, CELLS // int(size))):
                some = same[a : a + max(1, CELLS // int(size))]
                ids, counts[some] = segment(pieces, P.matrix(data, start[some], int(size)))
                parts.append((some, ids))
        begin = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int32)
        for some, ids in parts:
            out[B.runs(begin[some], counts[some])] = ids
        return out, counts

    return work


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids behind one another and the n + 1 places where each text's begin; null and empty texts have none."""
    data, start, end, first = words(texts, path)
    held, rows = _known("ids", path, data, start, end, _segmented(P.load(path), data))
    counts = held.at[rows + 1] - held.at[rows]
    return held.values[B.runs(held.at[rows], counts)], np.r_[0, np.cumsum(counts)][first]


@lru_cache(maxsize=2)
def _bytes_of(path: str) -> tuple[np.ndarray, np.ndarray]:
    pieces = P.load(path)
    units = [b""] * len(pieces.texts)
    for i in pieces.ids.tolist():
        units[i] = pieces.texts[i].replace("▁", " ").encode()
    for b, i in enumerate(pieces.byte_ids.tolist()):
        units[i] = bytes([b])
    return np.frombuffer(b"".join(units), np.uint8), np.r_[0, np.cumsum([len(u) for u in units])]


def decode(ids: np.ndarray, at: np.ndarray, path: str) -> pa.Array:
    """The texts of which ``encode`` gives these ids."""
    data, begins = _bytes_of(path)
    counts = begins[ids + 1] - begins[ids]
    out = data[B.runs(begins[ids], counts)]
    bounds = np.r_[0, np.cumsum(counts)][at]
    full = np.diff(bounds) > 0
    out = np.delete(out, bounds[:-1][full])  # the blank before each text
    bounds = bounds - np.r_[0, np.cumsum(full)]
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out)))


def trie_counts(pieces: P.Pieces, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Tokens of the best segmentation of each word. A level of the trie has a node per distinct prefix; its score comes from its ancestors'."""
    counts = np.zeros(len(start), np.int64)
    scores = np.r_[pieces.scores, -np.inf]
    worst = pieces.scores.min() - UNKNOWN
    power, inverse = B._powers(int((end - start).max()) + 2)
    spread = P._spread()
    alive = np.arange(len(start))
    node = np.zeros(len(start), np.int64)  # of each word alive, on the level before
    levels = [(np.zeros(1, np.uint64), np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64))]  # hash, score, tokens, parent
    depth = 0
    while len(alive):
        code = data[start[alive] + depth].astype(np.int64)
        depth += 1
        keys, first, node = np.unique(node << 21 | code, return_index=True, return_inverse=True)
        parent, last = keys >> 21, keys & 0x1FFFFF
        hashes = levels[-1][0][parent] + spread[last] * power[depth - 1]
        best, tokens = np.full(len(keys), -np.inf), np.zeros(len(keys), np.int64)
        above = parent
        for k in range(1, min(depth, pieces.longest) + 1):
            level = levels[-k]
            piece = pieces.find(B.mix((hashes - level[0][above]) * inverse[depth - k] + np.uint64(k * int(B._MUL) % (1 << 64))))
            score = scores[piece] if k > 1 else np.where(piece < 0, worst, scores[piece])
            total = level[1][above] + score
            better = total >= best
            best[better] = total[better]
            step = np.where(piece < 0, _byte_count(last), 1) if k == 1 else 1
            tokens = np.where(better, level[2][above] + step, tokens)
            above = level[3][above]
        levels.append((hashes, best, tokens, parent))
        del levels[: -pieces.longest]
        done = end[alive] - start[alive] == depth
        counts[alive[done]] = tokens[node[done]]
        alive, node = alive[~done], node[~done]
    return counts


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, "text"):
            text = batch.column("text")
            ids, at = encode(text, path)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()), mask=text.is_null())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "ids"])

    return run


def encode_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ids, an array of piece ids of the whole text, however long. Null text: null; empty: no ids.

    Of segmentations with equal sums the one with the longer last piece counts. Repeated rows repeat, an empty table gives no
    rows. A column ids is replaced, others stay whatever their names.
    """
    docs = docs.drop("ids")
    return mapped(docs, _encoded(path or P.default_path()), T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            at = np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
            # pieces of the batch keep the arrays small
            marks = np.flatnonzero(np.diff(at[:-1] >> 19, prepend=-1))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            for a, b in zip(marks, np.r_[marks[1:], batch.num_rows], strict=False):
                part = batch.slice(a, b - a)
                texts = decode(flat[at[a] : at[b]], at[a : b + 1] - at[a], path).cast(pa.string())
                texts = pc.if_else(part.column("ids").is_null(), None, texts)
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*batch.schema.names, "decoded"])

    return run


def decode_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with decoded, the text of the column ids (null: null; no ids: empty), of any length. Repeated rows repeat, an
    empty table gives no rows. A column decoded is replaced, others stay.
    """
    docs = docs.drop("decoded")
    return mapped(docs, _decoded(path or P.default_path()), T.StructType([*docs.schema.fields, T.StructField("decoded", T.StringType())]))


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = P.load(path)
        for batch in B.slices(batches, "text"):
            data, start, end, first = words(batch.column("text"), path)
            held, rows = _known("count", path, data, start, end, lambda a, b, data=data: (trie_counts(pieces, data, a, b), np.ones(len(a), np.int64)))
            total = np.r_[0, np.cumsum(held.values[held.at[rows]], dtype=np.int64)][first]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(first)), pa.array(np.diff(total))], [*batch.schema.names, "n_pretokens", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with n_pretokens and n_tokens of the whole text, however long; null and empty texts have 0. Ties are as in
    ``encode_texts``, so n_tokens is its number of ids. Repeated rows repeat, an empty table gives no rows. Columns with these
    names are replaced, others stay.
    """
    docs = docs.drop("n_pretokens", "n_tokens")
    return mapped(docs, _counted(path or P.default_path()), T.StructType([*docs.schema.fields, T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())]))
