"""Numpy work on whole batches of strings: slices of bounded size, word bounds and hashes.

All functions see the UTF-8 bytes of many texts behind one another; none loops over characters.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, which gives its memory back to the system at the end of the task, since workers live on."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    """Drops tables that are made again when needed, and returns free memory to the system."""
    _tables.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values after which every bit depends on every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * _MUL)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``limit`` bytes of text each; one text stays whole however long it is."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        bins = np.cumsum(sizes.astype(np.int64)) // limit
        starts = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(bins)], strict=True):
            yield batch.slice(a, b - a)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: none) and the n + 1 offsets of the texts in them."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "power" not in _tables or len(_tables["power"]) < n:
        size = max(n, SLICE_BYTES + 65536)
        for name, base in (("power", _BASE), ("inverse", _BASE_INVERSE)):
            _tables[name] = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)], dtype=np.uint64)
    return _tables["power"][:n], _tables["inverse"][:n]


def sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values * base ** place, modulo 2 ** 64, with a leading 0: what ``spans`` hashes from."""
    power, _ = _powers(len(values))
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * power, out=out[1:])
    return out


def spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span [start, end), the same wherever the span stands."""
    _, inverse = _powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * _MUL)


def byte_sums(data: np.ndarray, seed: int = 1) -> np.ndarray:
    key = f"bytes{seed}"
    if key not in _tables:
        _tables[key] = seeded(256, seed)
    return sums(_tables[key][data])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes over 32 (ASCII white space and controls part them), and the number of words before each text."""
    n = len(data)
    inside = data > 32
    edge = np.zeros(n + 1, bool)
    edge[1:n] = inside[1:] != inside[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    if n == 0:
        return at[:0], at[:0], np.zeros(len(offsets), np.int64)
    keep = inside[at[:-1]]
    start, end = at[:-1][keep], at[1:][keep]
    return start, end, np.searchsorted(start, offsets)


def runs(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... lengths[0] values, then those of the next run."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(first - before, lengths)
