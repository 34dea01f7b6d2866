"""Document fingerprints from improbable features.

A feature is a window of WINDOW bytes; every offset of a text begins one. Its rarity is the distance of its byte
entropy from TYPICAL, the entropy of common prose windows; equal rarities are ordered by a hash of the window. A
feature is selected if it is the rarest of at least POPULAR of the runs of RUN neighbouring windows; of a text with
fewer windows than a run all are. Selected features set BITS bits each in a chain of Bloom filters of FILTER bits,
FEATURES features to a filter. Likeness compares filters by their bit overlap beyond chance, normalised by the
greatest overlap possible.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import bytetext as B
from weftline.llm.session import mapped

WINDOW, RUN, POPULAR = 32, 64, 12
FILTER, BITS, FEATURES = 2048, 5, 160
TYPICAL = 3.7

_c = np.arange(WINDOW + 1)
_CLOGC = np.where(_c > 0, _c * np.log2(np.maximum(_c, 1)), 0)
_GAIN = np.round(np.diff(_CLOGC, prepend=0) * (1 << 20)).astype(np.int64)  # of the cth equal byte, in fixed point so that sums are exact


def _entropies(data: np.ndarray) -> np.ndarray:
    """Entropy in bits of the window at each offset: what a step takes away and brings in, summed up.

    The byte that leaves had as many equals in its window as stand in the WINDOW - 1 bytes behind it, the one that
    comes in as many as stand before it.
    """
    n = len(data)
    if n < WINDOW:
        return np.zeros(0)
    before, after = np.zeros(n, np.int8), np.zeros(n, np.int8)
    for d in range(1, WINDOW):
        same = data[d:] == data[:-d]
        before[d:] += same
        after[:-d] += same
    first = np.bincount(data[:WINDOW], minlength=256)
    steps = np.zeros(n - WINDOW + 1, np.int64)
    steps[0] = np.round(_CLOGC[first] * (1 << 20)).astype(np.int64).sum()
    steps[1:] = _GAIN[before[WINDOW:] + 1] - _GAIN[after[: n - WINDOW] + 1]
    return np.log2(WINDOW) - np.cumsum(steps) / ((1 << 20) * WINDOW)


def _runs(key: np.ndarray) -> np.ndarray:
    """The greatest of each RUN keys from each place on; the last places see fewer."""
    best = key.copy()
    step = 1
    while step < RUN:
        best[:-step] = np.maximum(best[:-step], best[step:])
        step *= 2
    return best


def _selected(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Selected keys in order and the number of them before each text; ``at`` has the number of keys before each text."""
    count = np.diff(at)
    text = np.repeat(np.arange(len(count)), count)
    best = _runs(key) if len(key) > RUN else key
    whole = np.arange(len(key)) + RUN <= at[text + 1]
    new = np.ones(len(key), bool)  # where the rarest of a run is another than that of the run before
    new[1:] = (best[1:] != best[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])
    begin = np.flatnonzero(new)
    votes = np.diff(np.r_[begin, len(key)])
    short = count[text] < RUN
    chosen = begin[(votes >= POPULAR) & whole[begin]]
    places = np.r_[chosen, np.flatnonzero(short)]
    keys = np.r_[best[chosen], key[short]]
    order = np.argsort(places, kind="stable")
    return keys[order], np.searchsorted(places[order], at)


def filters(texts: pa.Array) -> list[np.ndarray]:
    """The chain of Bloom filters of each text, a row of FILTER / 64 words per filter; an empty text has none."""
    data, offsets = B.raw(texts)
    n = len(offsets) - 1
    size = np.diff(offsets)
    none = np.zeros((0, FILTER // 64), np.uint64)
    count = np.maximum(size - WINDOW + 1, np.minimum(size, 1))  # a text too short for a window is its own
    if not count.sum():
        return [none] * n
    at = np.r_[0, np.cumsum(count)]
    start = B.runs(offsets[:-1], count)
    hashes = B.spans(B.byte_sums(data, 4), start, np.minimum(start + WINDOW, np.repeat(offsets[1:], count)))
    rarity = np.zeros(len(start))
    full = np.repeat(size >= WINDOW, count)
    rarity[full] = np.abs(_entropies(data)[start[full]] - TYPICAL)
    key = (np.round(rarity * 64).astype(np.uint64) << np.uint64(54)) | (hashes >> np.uint64(10))
    kept, before = _selected(key, at)
    counts = np.diff(before)
    chains = -(-counts // FEATURES)
    base = np.r_[0, np.cumsum(chains)]
    rank = B.runs(np.zeros(n, np.int64), counts)
    row = np.repeat(base[:-1], counts) + rank // FEATURES
    bits = np.zeros((int(base[-1]), FILTER), bool)
    kept = B.mix(kept)
    for k in range(BITS):
        bits[row, (kept >> np.uint64(11 * k)) & np.uint64(FILTER - 1)] = True
    packed = np.packbits(bits, axis=1).view(np.uint64)
    return [packed[a:b] if b > a else none for a, b in zip(base[:-1], base[1:], strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: the mean over the shorter chain's filters, weighted by their bits, of the best normalised overlap with the other's."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return float(not len(b))
    na, nb = (np.bitwise_count(x).sum(axis=1).astype(np.float64) for x in (a, b))
    both = np.stack([np.bitwise_count(x & b).sum(axis=1) for x in a]).astype(np.float64)
    chance = na[:, None] * nb / FILTER
    most = np.minimum(na[:, None], nb)
    best = np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1).max(axis=1)
    return float((best * na).sum() / na.sum())


def text_of(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows in order, each row's next behind it; borrowed rows serve as a next only."""
    ids: list = []
    texts: list[str] = []
    lent: list[bool] = []
    for batch in B.slices(batches, "text"):
        ids += batch.column("doc_id").to_pylist()
        texts += [t or "" for t in batch.column("text").to_pylist()]
        lent += batch.column("borrowed").to_pylist()
        if len(ids) < 2:
            continue
        chains = filters(pa.array(texts, pa.large_string()))
        rows = [i for i in range(len(ids) - 1) if not lent[i]]
        cuts = [len(texts[i]) // 4 for i in rows]
        edited = [texts[i][: len(texts[i]) - c] + texts[i + 1][:c] for i, c in zip(rows, cuts, strict=True)]
        changed = filters(pa.array(edited, pa.large_string()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([ids[i] for i in rows], pa.int64()),
                pa.array([len(texts[i]) for i in rows], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([text_of(chains[i]) for i in rows], pa.string()),
                pa.array([text_of(c) for c in changed], pa.string()),
                pa.array([likeness(chains[i], c) for i, c in zip(rows, changed, strict=True)], pa.float64()),
                pa.array([likeness(chains[i], chains[i + 1]) for i in rows], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )
        ids, texts, lent = ids[-1:], texts[-1:], lent[-1:]


def _in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text, borrowed in ranges of doc_id, each range followed by the first row of the next (the last by the first's).

    Range bounds and first rows are one per range; rows of one doc_id are ordered by a hash of the text.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_o"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_h"))
    points = docs.agg(F.percentile_approx("_o", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0] or []
    splits = [-float("inf"), *sorted({float(p) for p in points}), float("inf")]
    placed = Bucketizer(splits=splits, inputCol="_d", outputCol="_b").transform(docs.withColumn("_d", F.col("_o").cast("double"))) if len(splits) > 2 else docs.withColumn("_b", F.lit(0.0))
    placed = placed.withColumn("_b", F.col("_b").cast("int"))
    heads = sorted(placed.groupBy("_b").agg(F.min(F.struct("_o", "_h")).alias("head")).collect())
    to = [(r["_b"], r["head"]["_o"], r["head"]["_h"], heads[i - 1]["_b"]) for i, r in enumerate(heads)]
    to = F.broadcast(spark.createDataFrame(to, "_b int, _fo long, _fh long, _before int"))  # a row per range
    first = (F.col("_o") == F.col("_fo")) & (F.col("_h") == F.col("_fh"))
    here = F.struct(F.col("_b").alias("b"), F.lit(False).alias("borrowed"))
    there = F.struct(F.col("_before").alias("b"), F.lit(True).alias("borrowed"))
    rows = placed.join(to, "_b").select("doc_id", "text", "_o", "_h", F.explode(F.when(first, F.array(here, there)).otherwise(F.array(here))).alias("at"))
    return rows.repartition(buckets, "at.b").sortWithinPartitions("at.b", "at.borrowed", "_o", "_h").select("doc_id", "text", "at.borrowed")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row of ``docs``.

    The edited text is the text with its last quarter (floor of code points / 4) replaced by as many of the first code
    points of the next row's text, or all; next goes by ascending doc_id, nulls first, rows of one doc_id by a hash of
    their texts, and the first follows the last. Null counts as empty; the fingerprint of an empty text is empty,
    like another empty one (1) and unlike all others (0). Other columns are ignored; an empty table gives no rows.
    """
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return mapped(_in_order(docs, buckets), _digested, schema)
