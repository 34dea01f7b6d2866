"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its whole text. The model is learned from
preference pairs (a good document against a bad one) of all labelled rows by logistic loss on feature differences. The cut
between bad and good is a quantile of the training scores: the share of bad labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import bytetext as B
from weftline.llm.session import dropped, mapped, stored

FEATURES = (
    "symbol_ends", "bang_ends", "bars", "upper", "digits", "beyond_ascii", "marks", "again_1", "again_2", "again_3",
    "word_length", "lines", "line_again", "log_words", "no_end_mark",
)
CUT = 0.3
PAIRS, BLOCK, LEAST_OTHERS = 4, 4096, 64  # pairs of a row of the more frequent class; rows of that class and of the other one in a block


@dataclass(frozen=True)
class QualityModel:
    center: np.ndarray
    weight: np.ndarray
    cut: float


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _LOWER, _DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(bytes(range(48, 58)))
_MARKS = _class(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_ENDS = _class(b".,;:?\"')")


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES per text, each between 0 and about 1 but for log_words; empty texts have zeros."""
    data, offsets = B.raw(texts)
    n = len(texts)
    start, end, first = B.words(data, offsets)
    word, begin = np.diff(first), first[:-1]
    size = np.diff(offsets)

    def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(values, dtype=np.int64)]
        return (total[at[1:]] - total[at[:-1]]).astype(float)

    words, chars = np.maximum(word, 1), np.maximum(size, 1)
    last = data[end - 1] if len(end) else data[:0]
    marked = _MARKS[last] & ~_ENDS[last]
    alone = end - start == 1
    hashes = B.spans(B.byte_sums(data), start, end)
    place = np.arange(len(start)) - np.repeat(begin, word)
    upper, lower = per_text(_UPPER[data], offsets), per_text(_LOWER[data], offsets)
    out = np.zeros((n, len(FEATURES)))
    out[:, 0] = per_text(marked & ~alone & (last != 33), first) / words
    out[:, 1] = per_text((last == 33) & ~alone, first) / words
    out[:, 2] = per_text(alone & marked, first) / words
    out[:, 3] = upper / np.maximum(upper + lower, 1)
    out[:, 4] = per_text(_DIGIT[data], offsets) / chars
    out[:, 5] = per_text(data > 127, offsets) / chars
    out[:, 6] = per_text(_MARKS[data], offsets) / chars
    for lag in (1, 2, 3):
        same = np.zeros(len(start), bool)
        same[lag:] = (hashes[lag:] == hashes[:-lag]) & (place[lag:] >= lag)
        out[:, 6 + lag] = per_text(same, first) / words
    out[:, 10] = per_text(end - start, first) / words / 20
    breaks = data == 10
    out[:, 11] = per_text(breaks, offsets) / words
    edge = np.zeros(len(data) + 1, bool)
    edge[1:] = breaks
    edge[offsets] = True
    at = np.flatnonzero(edge)
    line = B.spans(B.byte_sums(data), at[:-1], at[1:]) if len(at) > 1 else np.zeros(0, np.uint64)
    whole = np.r_[np.searchsorted(at, offsets)]
    again = np.zeros(len(line), bool)
    again[1:] = line[1:] == line[:-1]
    out[:, 12] = per_text(again, whole) / np.maximum(np.diff(whole), 1)
    out[:, 13] = np.log1p(word) / 10
    ended = np.zeros(len(start), bool)
    ended[:] = _ENDS[last]
    out[:, 14] = np.where(word > 0, 1 - per_text(ended, first) / words, 0)
    return np.sqrt(np.maximum(out, 0))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in B.slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(features(batch.column("text")))], ["doc_id", "x"])


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int = 40_000, penalty: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Weights that minimise mean log(1 + exp(-w (good - bad))) + penalty |w|^2 / 2 over fixed random pairs, by Newton steps."""
    chosen = np.random.default_rng(1)
    d = good[chosen.integers(len(good), size=pairs)] - bad[chosen.integers(len(bad), size=pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        slope = penalty * w - d.T @ p / pairs
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _paired(block: pa.Table) -> pa.Table:
    """Differences good - bad of a block of rows: each row of the larger class meets PAIRS ones of the other, which all come in turn."""
    y = block["label"].to_numpy().astype(bool)
    x = block["x"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    x, y = x[order := np.lexsort((*x.T, y))], y[order]
    good, bad = x[y], x[~y]
    if not len(good) or not len(bad):
        return pa.table([_lists(np.zeros((0, x.shape[1])))], ["d"])
    large, small = (good, bad) if len(good) >= len(bad) else (bad, good)
    chosen = np.random.default_rng(1)
    turn = np.tile(chosen.permutation(len(small)), -(-PAIRS * len(large) // len(small)))[: PAIRS * len(large)]
    d = np.repeat(large[chosen.permutation(len(large))], PAIRS, axis=0) - small[turn]
    return pa.table([_lists(d if large is good else -d)], ["d"])


def _pairs(rows: DataFrame, good: int, bad: int) -> DataFrame:
    """d, differences of pairs of all ``rows`` (doc_id, label, x), in blocks of about BLOCK rows of the more frequent class; where the other one is rare, its rows stand in several blocks."""
    blocks = -(-max(good, bad) // BLOCK)
    times = min(blocks, -(-LEAST_OTHERS * blocks // min(good, bad)))
    rare = int(good < bad)
    copies = F.when(F.col("label") == rare, F.sequence(F.lit(0), F.lit(times - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.select("label", "x", F.xxhash64("doc_id").alias("_h"), F.explode(copies).alias("_i"))
    return dealt.select("label", "x", F.pmod(F.col("_h") + F.col("_i"), F.lit(blocks)).alias("block")).groupBy("block").applyInArrow(_paired, "d array<double>")


def _newton_sums(w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(w) * (len(w) + 1) + 1)
        for batch in batches:
            d = batch.column("d").flatten().to_numpy().reshape(batch.num_rows, len(w))
            p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
            total += np.r_[d.T @ p, ((d * (p * (1 - p))[:, None]).T @ d).ravel(), len(d)]
        yield pa.RecordBatch.from_arrays([_lists(total[None])], ["sums"])

    return run


def _weights(pairs: DataFrame, width: int, penalty: float = 1e-3, steps: int = 30) -> np.ndarray:
    """As ``bradley_terry``, over a table of differences: a step sums slope and curve where the rows are."""
    w = np.zeros(width)
    for _ in range(steps):
        each = mapped(pairs, _newton_sums(w), "sums array<double>").select(F.posexplode("sums").alias("i", "v"))
        got = np.array([r.v for r in each.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()])  # width * (width + 1) + 1 numbers
        slope = penalty * w - got[:width] / got[-1]
        step = np.linalg.solve(got[width:-1].reshape(width, width) / got[-1] + penalty * np.eye(width), slope)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _ranked(values: DataFrame, rank: int, bins: int = 4096) -> float:
    """The exact value of column s with ``rank`` (from 0) smaller or equal ones before it: the bin that holds it is cut again until it has one value."""
    low, high = values.agg(F.min("s"), F.max("s")).first()
    while low < high:
        within = values.filter(F.col("s").between(low, high)).withColumn("bin", F.floor((F.col("s") - low) / (high - low) * bins))
        for r in within.groupBy("bin").agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("bin").collect():  # at most bins + 1 rows
            if rank < r.n:
                break
            rank -= r.n
        low, high = r.low, r.high
    return low


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """A model from all rows of ``labels`` (doc_id, quality) whose documents are in ``docs`` (doc_id, text). Null labels teach nothing.

    Features are counted where the texts are; only they are shuffled and stored. Every labelled row is in a pair, and the cut is exact over all of them.
    Without both good and bad documents the model scores every text 1.
    """
    spark = docs.sparkSession
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    asked = docs.select("doc_id", "text").filter("doc_id is not null")
    schema = T.StructType([asked.schema["doc_id"], T.StructField("x", T.ArrayType(T.DoubleType()))])
    rows, rows_at = stored(mapped(asked, _featured, schema).join(known, "doc_id").select("doc_id", "label", "x"))
    width = len(FEATURES)
    n, good, *center = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0)), *(F.avg(F.col("x")[i]) for i in range(width))).first()
    if good in (0, n):
        dropped(spark, rows_at)
        return QualityModel(np.zeros(width), np.zeros(width), -math.inf)
    pairs, pairs_at = stored(_pairs(rows, good, n - good))
    weight = _weights(pairs, width)
    dropped(spark, pairs_at)
    strength = sum((F.col("x")[i] - F.lit(float(c))) * F.lit(float(w)) for i, (c, w) in enumerate(zip(center, weight, strict=True)))
    scores = rows.select(strength.alias("s"))
    bad = n - good
    cut = (_ranked(scores, bad - 1) + _ranked(scores, min(bad, n - 1))) / 2
    dropped(spark, rows_at)
    return QualityModel(np.array(center), weight, cut)


def _scored(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, "text"):
            if math.isinf(model.cut):
                score = np.ones(batch.num_rows)
            else:
                s = (features(batch.column("text")) - model.center) @ model.weight - model.cut
                score = 1 / (1 + np.exp(-np.clip(s + math.log(CUT / (1 - CUT)), -500, 500)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), pa.array(score), pa.array((score >= CUT).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return run


def rate(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with score (0 to 1, from the whole text) and predicted (1 if score >= CUT).

    Null, empty and blank texts are scored by their zero features. Equal texts have equal scores.
    Columns of ``docs`` with the two names are replaced; others stay.
    """
    docs = docs.drop("score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return mapped(docs, _scored(model), schema)


def held_out() -> Column:
    """Whether a row of the query is held out: crc32 of doc_id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
