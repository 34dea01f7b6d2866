"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets verify them.

Equal word sequences first fall together into one class, whose size is its weight. One
representative of each class is sketched by MinHash; representatives that share a band are
candidates. Candidates are linked to the least of their bucket only, so a bucket of m rows gives
m - 1 edges; the components of those edges hold every candidate pair. Each component is cut into
blocks of bounded size, and each pair of blocks is verified in one task by products of incidence
matrices, which counts the links of each row and returns a spanning forest instead of the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import bytetext as B
from weftline.llm.groups import components, sorted_groups
from weftline.llm.session import cut, mapped


def bands_for(threshold: float, recall: float, most_hashes: int = 160) -> tuple[int, int]:
    """(bands, rows): the most rows for which bands that reach ``recall`` at ``threshold`` need no more than ``most_hashes`` hashes; where even one row needs more, as many as it needs."""
    best = (0, 0)
    for rows in range(1, most_hashes + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))) if threshold < 1 else 1
        if bands * rows > most_hashes and rows > 1:
            break
        best = (bands, rows)
    return best


def _shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-gram hashes of all texts, the n + 1 places where each text's begin, and a 128-bit key of each text's word sequence.

    A text of 1 to n - 1 words has one n-gram, all its words; one without words has none.
    """
    data, offsets = B.raw(pc.utf8_lower(pc.fill_null(texts, "")))
    start, end, first = B.words(data, offsets)
    hashes = B.spans(B.byte_sums(data), start, end)
    count = np.diff(first)
    over = B.sums(hashes)
    begin, stop = first[:-1], first[1:]
    key = np.stack([B.spans(over, begin, stop), B.spans(B.sums(B.mix(hashes + np.uint64(7))), begin, stop)], axis=1)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = B.runs(begin, grams)
    return B.spans(over, at, np.minimum(at + n, np.repeat(stop, grams))), np.r_[0, np.cumsum(grams)], key


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _keys(key: np.ndarray, empty: np.ndarray) -> pa.Array:
    packed = np.ascontiguousarray(key).view("S16").ravel()
    return pc.if_else(pa.array(empty), None, _binary(key, np.arange(len(packed) + 1) * 16))


def sketches(n: int, bands: int, rows: int):
    scale, shift = B.seeded(bands * rows, 11) | np.uint64(1), B.seeded(bands * rows, 12)
    salt = B.seeded(bands, 13)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, "text"):
            grams, at, key = _shingles(batch.column("text"), n)
            full = np.flatnonzero(np.diff(at))
            out = np.zeros((batch.num_rows, bands), np.uint64)
            if len(full):
                for band in range(bands):
                    total = np.full(len(full), salt[band])
                    for k in range(band * rows, (band + 1) * rows):
                        total = B.mix(total + np.minimum.reduceat(grams * scale[k] + shift[k], at[full]))
                    out[full, band] = total
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bands), pa.array(out.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _keys(key, np.diff(at) == 0), lists], ["doc_id", "key", "bands"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, "text"):
            grams, at, key = _shingles(batch.column("text"), n)
            yield pa.RecordBatch.from_arrays([_keys(key, np.diff(at) == 0), _binary(grams, at * 8)], ["node", "grams"])

    return run


def overlaps(sets: list[np.ndarray], left: int, chunk: int = 8192) -> np.ndarray:
    """Sizes of the intersections of each of the first ``left`` sets with each of the others (left = len(sets): of all with all)."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    whole = left == len(sets)
    out = np.zeros((left, len(sets) if whole else len(sets) - left), np.float32)
    top = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, top, chunk):
        a, b = np.searchsorted(column, (low, low + chunk))
        dense = np.zeros((len(sets), min(chunk, top - low)), np.float32)
        dense[owner[a:b], column[a:b] - low] = 1
        out += dense @ dense.T if whole else dense[:left] @ dense[left:].T
    return out


def _verify(threshold: float):
    def one(group: pa.Table) -> tuple[list[bytes], np.ndarray, list[bytes]]:
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        block = group["block"].to_numpy()
        order = np.argsort(block != i, kind="stable")
        nodes, grams, weight = group["node"].to_pylist(), group["grams"].to_pylist(), group["weight"].to_numpy()[order]
        nodes = [nodes[k] for k in order]
        sets = [np.unique(np.frombuffer(grams[k], np.uint64)) for k in order]
        size = np.array([len(s) for s in sets])
        left = len(sets) if i == j else int((block == i).sum())
        if left == 0 or (i != j and left == len(sets)):
            return nodes, np.zeros(len(nodes), np.int64), nodes
        both = overlaps(sets, left)
        other = np.arange(len(sets)) if i == j else np.arange(left, len(sets))
        linked = both >= threshold * (size[:left, None] + size[None, other] - both) - 1e-4
        if i == j:
            np.fill_diagonal(linked, False)
            links, joined = linked @ weight, linked
        else:
            links = np.r_[linked @ weight[left:], linked.T @ weight[:left]]
            joined = np.zeros((len(sets), len(sets)), bool)
            joined[:left, left:] = linked
            joined[left:, :left] = linked.T
        root = np.arange(len(sets))
        while True:
            low = np.where(joined, root[None, :], len(sets)).min(axis=1)
            low = np.minimum(root, low)
            low = low[low]
            if (low == root).all():
                return nodes, links, [nodes[k] for k in root]
            root = low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["comp", "i", "j"]):
            nodes, links, roots = one(group)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(links, pa.int64()), pa.array(roots, pa.binary())], ["node", "links", "root"])

    return run


def near_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, block: int = 256) -> DataFrame:
    """Per row of ``docs``: doc_id, class_id, n_links, n_copies.

    Words are runs of characters other than ASCII white space, in lower case. Two texts are linked if the Jaccard
    similarity of their sets of n-word shingles is at least ``threshold``; classes are the components
    of links, named by their least doc_id. n_links counts the other rows that a row is linked with, its
    copies among them; n_copies those with the same words. Candidate recall at the threshold is ``recall``.

    A text of fewer than n words has one shingle, all its words. Null, empty and blank texts have none:
    such a row is a class of its own without links. Repeated rows are copies. A null doc_id never names a
    class that has another id. Other columns are ignored. An empty table gives no rows.
    """
    count, rows = bands_for(threshold, recall)
    plain = docs.select("doc_id", "text")
    sketched = cut(mapped(plain, sketches(n, count, rows), "doc_id long, key binary, bands array<long>"))
    nodes = cut(sketched.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.first("bands").alias("bands")))
    banded = nodes.select("key", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("key").alias("center"), F.count("*").alias("m")).filter("m > 1").drop("m")
    candidates = components(banded.join(buckets, "bucket").select(F.col("key").alias("a"), F.col("center").alias("b")))
    member = candidates.unionByName(candidates.select(F.col("root").alias("node"), "root").distinct())
    sizes = member.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    member = cut(member.join(sizes, "root").join(nodes.select(F.col("key").alias("node"), "rep", "weight"), "node").select("node", "rep", "weight", F.col("root").alias("comp"), "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block")))

    texts = plain.join(member.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    # a repeated doc_id may bring other texts along: the key tells which one the node stands for
    sets = mapped(texts, _sets(n), "node binary, grams binary").groupBy("node").agg(F.first("grams").alias("grams"))
    pairs = (
        member.join(sets, "node")
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("comp", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "block", "node", "weight", "grams")
    )
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    verified = cut(mapped(pairs.repartition(width, "comp", "i", "j").sortWithinPartitions("comp", "i", "j"), _verify(threshold), "node binary, links long, root binary"))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = (
        nodes.select("key", "rep", "weight")
        .join(roots.withColumnRenamed("node", "key"), "key", "left")
        .join(links.withColumnRenamed("node", "key"), "key", "left")
        .select("key", "rep", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "key").alias("root"))
    )
    classes = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = named.join(classes, "root").select("key", "class_id", (F.col("links") + F.col("weight") - 1).alias("n_links"), (F.col("weight") - 1).alias("n_copies"))
    return sketched.select("doc_id", "key").join(named, "key", "left").select(
        "doc_id",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_copies", F.lit(0)).alias("n_copies"),
    )
