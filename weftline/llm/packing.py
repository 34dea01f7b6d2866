"""Best-fit packing by a configuration linear program over the histogram of lengths.

Only the histogram (at most ``capacity`` counts) is seen as a whole. A configuration is a multiset of
lengths that fills one sequence. The program, fewest configurations that cover the counts, is solved by
multiplicative weights; a knapsack dynamic program prices the best configuration of each round. The
solution is rounded down, what is left is packed by best fit on the histogram, and the rows take their
places by their rank among the rows of their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import bytetext as B
from weftline.llm.pretokens import encoder
from weftline.llm.session import cut, mapped

CAPACITY = 2048


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _pieces(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, "text"):
            ids, at = encoder(path).encode(batch.column("text"))
            ids = np.insert(ids, at[1:], end).astype("<u4")
            at = at + np.arange(len(at))
            size = np.diff(at)
            parts = -(-size // capacity)
            row = np.repeat(np.arange(batch.num_rows), parts)
            piece = B.runs(np.zeros(len(parts), np.int64), parts)
            first = size - (parts - 1) * capacity  # the first piece may be shorter
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[row], capacity)
            where = at[row] + start
            whole = memoryview(np.ascontiguousarray(ids)).cast("B")
            crc = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(where.tolist(), (where + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """Per piece of each document: doc_id, piece, start, length, ids_crc32. Null text counts as empty: one piece, the end id alone."""
    return mapped(docs.select("doc_id", "text"), _pieces(path or default_path(), capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long")


def knapsack(price: np.ndarray, least: int, capacity: int) -> list[int]:
    """Lengths (with repeats) of at most ``capacity`` in all and of the greatest total price; price[l] < 0 bars l."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    backwards = price[::-1]  # so that best[c - l] + price[l] is a sum of two slices
    top = len(price) - 1
    for c in range(least, capacity + 1):
        longest = min(c, top)
        total = best[c - longest : c - least + 1] + backwards[top - longest : top - least + 1]
        k = int(total.argmax())
        best[c], choice[c] = max((best[c - 1], 0), (float(total[k]), longest - k))
    out, c = [], capacity
    while c >= least:
        if choice[c]:
            out.append(int(choice[c]))
            c -= int(choice[c])
        else:
            c -= 1
    return out


def solve(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = 300, rate: float = 2.0, step: float = 0.9) -> list[tuple[tuple[int, ...], int]]:
    """(configuration, times) pairs that hold counts[l] pieces of each length l exactly.

    Multiplicative weights: a length is priced by its share of a sequence times a weight, the knapsack finds the
    best configuration for these prices, and the fractional solution uses it for ``step`` of what its
    scarcest length allows. Each use multiplies the weights of its lengths by exp(-rate * share of the count
    it covers). The fractions are rounded down; best fit packs what that leaves.
    """
    every = np.arange(capacity + 1)
    short = counts.astype(float).copy()
    weight = np.ones(capacity + 1)
    used: Counter[tuple[int, ...]] = Counter()
    for _ in range(rounds):
        open_ = np.flatnonzero(short > 0.01 * counts)
        if not len(open_):
            break
        price = np.full(capacity + 1, -1.0)
        price[open_] = every[open_] / capacity * weight[open_]
        config = knapsack(price, int(open_[0]), capacity)
        need = Counter(config)
        times = step * min(short[length] / k for length, k in need.items())
        for length, k in need.items():
            short[length] -= times * k
            weight[length] *= np.exp(-rate * times * k / counts[length])
        used[tuple(sorted(config, reverse=True))] += times
    left = counts.astype(np.int64).copy()
    out: Counter[tuple[int, ...]] = Counter()
    for config, times in used.items():
        n = min(int(times), *(int(left[length] // k) for length, k in Counter(config).items()))
        if n > 0:
            out[config] += n
            for length, k in Counter(config).items():
                left[length] -= n * k
    for config, n in best_fit(left, capacity).items():
        out[config] += n
    return sorted(out.items(), reverse=True)


def best_fit(counts: np.ndarray, capacity: int = CAPACITY) -> Counter[tuple[int, ...]]:
    """Best-fit decreasing on a histogram: the longest length left, then again and again the longest that still fits, as many times as the counts allow at once."""
    left = counts.astype(np.int64).copy()
    out: Counter[tuple[int, ...]] = Counter()
    lengths = np.flatnonzero(left)
    while len(lengths):
        config, room = Counter(), capacity
        while True:
            fits = lengths[: np.searchsorted(lengths, room, side="right")]
            free = next((int(x) for x in fits[::-1] if left[x] > config[int(x)]), 0)
            if not free:
                break
            k = min(room // free, int(left[free]) - config[free])
            config[free] += k
            room -= k * free
        n = min(int(left[x]) // k for x, k in config.items())
        out[tuple(sorted(config.elements(), reverse=True))] += n
        for x, k in config.items():
            left[x] -= n * k
        lengths = lengths[left[lengths] > 0]
    return out


def places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: from which rank on, in which first sequence, and at which offset its pieces stand (one per sequence)."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    taken: Counter[int] = Counter()
    sequence = 0
    for config, times in plan:
        offset = 0
        for length in config:
            rows.setdefault(length, []).append((taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return {length: tuple(np.array(x, np.int64).T) for length, x in rows.items()}


def _placed(where: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            marks = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0]) if len(order) else order
            for a, b in zip(marks, np.r_[marks[1:], len(order)], strict=False):
                some = order[a:b]
                begin, first, at = where[int(length[some[0]])]
                k = np.searchsorted(begin, rank[some], side="right") - 1
                sequence[some], offset[some] = first[k] + rank[some] - begin[k], at[k]
            columns = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, rounds: int = 300) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; see the module.

    A null or empty text is one piece of length 1 (its end id). Repeated rows are pieces of their own, also if
    doc_id is null. Other columns are ignored; an empty table gives no rows.
    """
    pieces = cut(token_pieces(docs, path, capacity))
    # rank among the pieces of a length: parts by a hash keep a length that is very frequent out of one task
    parts = 64 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    counted = cut(spread.groupBy("length", "part").agg(F.count("*").alias("n")))
    totals = counted.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for r in totals:
        histogram[r["length"]] = r["n"]
    where = places(solve(histogram, capacity, rounds))
    before = counted.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = spread.withColumn("k", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1).join(before, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("k") + F.col("before")).alias("rank"))
    return mapped(ranked, _placed(where), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
