"""Exact top-k inner products with block-at-a-time pruning.

Vectors are cut into blocks of consecutive ids. A block has a summary, the greatest and least value of each dimension
(the term maxima), and a forward index, its ids and integer components. A query bounds a block by the sum over its
dimensions of the better of the two products. Queries go in parts; a part sees the summaries of all blocks, never
their vectors. First each query scores the block of its greatest bound in each slice of the summaries, which gives a
score that its kth best reaches. Then each part keeps the blocks whose bounds reach that score for one of its queries, and only these forward
indexes are sent to it, in shards; within a shard blocks are scored by falling bound until bounds are below the kth score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.groups import sorted_groups
from weftline.llm.session import cut, mapped

BLOCK = 256  # vectors
SHARD = 64  # blocks that a task gets together
QUERIES = 4096  # queries of a part
SLICE = 1024  # summaries that a task gets together
FAR = 1 << 62  # components beyond it are moved to it: no long holds their products


def _blocks(size: int, scale: int):
    """Blocks of at most ``size`` vectors of one length from rows sorted by id: dims, ids, values, top, low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def flush(dims: int) -> pa.RecordBatch:
            rows = held.pop(dims)
            values = _packed(np.array([v for _, v in rows], np.int64).reshape(len(rows), dims))
            ids = np.array([i for i, _ in rows], np.int64)
            parts = [ids, values, values.max(axis=0), values.min(axis=0)]
            return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], ["dims", "ids", "values", "top", "low"])

        for batch in batches:
            lists = batch.column("embedding")
            flat, lengths = lists.flatten(), pc.list_value_length(lists).fill_null(-1).to_numpy(zero_copy_only=False)
            missing = flat.is_null().to_numpy(zero_copy_only=False)
            flat = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.r_[0, np.cumsum(np.maximum(lengths, 0))]
            wrong = np.r_[0, np.cumsum(missing | ~np.isfinite(flat))]
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(np.where(np.isfinite(flat), flat, 0) * scale), -FAR, FAR).astype(np.int64)
            for i, name in enumerate(batch.column("vec_id").to_pylist()):
                a, b = at[i], at[i + 1]
                if name is None or lengths[i] < 1 or wrong[b] > wrong[a]:
                    continue
                dims = int(b - a)
                held.setdefault(dims, []).append((name, whole[a:b]))
                if len(held[dims]) == size:
                    yield flush(dims)
        for dims in [*held]:
            yield flush(dims)

    return run


def _packed(values: np.ndarray) -> np.ndarray:
    """As 32-bit integers where all fit."""
    return values.astype(np.int32) if np.abs(values).max(initial=0) < 1 << 31 else values


def _matrix(values: bytes, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(values, np.int32 if len(values) == 4 * rows * dims else np.int64).reshape(rows, dims)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T exactly: by floating point where no sum can leave its 53 bits. What leaves 64 bits is moved to their end."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    whole = a.astype(object) @ b.T.astype(object)
    return np.clip(whole, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def _bounds(query: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """At least the score of each query with any vector between low and top (a row per block)."""
    up, down = _product(np.maximum(query, 0), top), _product(np.minimum(query, 0), low)
    far = (up > 2**62) & (down > 0) | (down < -(2**62)) & (up < 0)
    return np.where(far, 2**63 - 1, up + np.where(far, 0, down))


def search(query: np.ndarray, names: np.ndarray, least: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], int]:
    """(query number, vec_ids, scores) of up to k best, and the number of blocks scored.

    ``least`` is a score that each query's kth best is known to reach; ``blocks`` are (ids, values, top, low).
    """
    bounds = _bounds(query, np.stack([b[2] for b in blocks]), np.stack([b[3] for b in blocks]))
    order = np.argsort(-bounds, axis=1, kind="stable")
    found: list[list[np.ndarray]] = [[np.zeros(0, np.int64), np.zeros(0, np.int64)] for _ in names]
    kth = least.copy()
    scored = 0
    for step in range(len(blocks)):
        block_of = order[:, step]
        open_ = np.flatnonzero(bounds[np.arange(len(names)), block_of] >= kth)
        if not len(open_):
            break
        for b in np.unique(block_of[open_]):
            rows = open_[block_of[open_] == b]
            ids, values = blocks[b][0], blocks[b][1]
            score = _product(query[rows], values)
            scored += len(rows)
            for r, s in zip(rows, score, strict=True):
                good = np.flatnonzero((s >= kth[r]) & (ids != names[r]))
                if len(good):
                    ids_, s_ = np.r_[found[r][0], ids[good]], np.r_[found[r][1], s[good]]
                    best = np.lexsort((ids_, -s_))[:k]
                    found[r] = [ids_[best], s_[best]]
                    if len(best) == k:
                        kth[r] = max(kth[r], found[r][1][-1])
    return [(i, *x) for i, x in enumerate(found) if len(x[0])], scored


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict]]:
    """(part of queries, summary of a block) over rows sorted by part and slice with the queries first; only a part's queries are held."""
    part: dict = {}
    for batch in batches:
        for r in batch.to_pylist():
            if r["query"]:
                part = r | {"ids": np.frombuffer(r["ids"], np.int64)}
                part["values"] = _matrix(r["values"], len(part["ids"]), r["dims"])
                part["least"] = np.frombuffer(r["least"], np.int64) if r["least"] is not None else None
            elif part and (part["part"], part["slice"]) == (r["part"], r["slice"]):
                yield part, r


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[int], np.ndarray]]:
    """A part of queries, numbers of up to SHARD blocks and the bounds of all its queries (rows) with them."""

    def bounds(part: dict, held: list[dict]) -> tuple[dict, list[int], np.ndarray]:
        top, low = (np.stack([_matrix(h[x], 1, h["dims"])[0] for h in held]) for x in ("top", "low"))
        return part, [h["n"] for h in held], _bounds(part["values"], top, low)

    last, held = None, []
    for part, r in _parts(batches):
        if held and (last is not part or len(held) == SHARD):
            yield bounds(last, held)
            held = []
        last = part
        held.append(r)
    if held:
        yield bounds(last, held)


def _seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, block, query numbers): the block of each query's greatest bound in a slice, of equal ones the first."""

    def flush(part: dict, block: np.ndarray) -> pa.RecordBatch:
        names = np.unique(block)
        rows = [np.flatnonzero(block == b).astype(np.int32) for b in names]
        n = pa.array([part["part"]] * len(names), pa.int64())
        return pa.RecordBatch.from_arrays([n, pa.array(names), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([part["values"][r].tobytes() for r in rows], pa.binary()), pa.array([part["ids"][r].tobytes() for r in rows], pa.binary())], ["part", "n", "rows", "asked", "names"])

    last: dict | None = None
    best = block = np.zeros(0, np.int64)
    for part, numbers, bounds in _several(batches):
        if last is not part:
            if last is not None:
                yield flush(last, block)
            last, best, block = part, np.full(len(part["ids"]), np.iinfo(np.int64).min), np.full(len(part["ids"]), numbers[0])
        top = bounds.argmax(axis=1)
        value = bounds[np.arange(len(top)), top]
        better = value > best
        best[better], block[better] = value[better], np.array(numbers)[top[better]]
    if last is not None:
        yield flush(last, block)


def _kth(k: int):
    """(part, query numbers, kth scores) of queries with the one block that each is seeded by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ids, names = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["names"], np.int64)
                score = _product(_matrix(r["asked"], len(names), r["dims"]), _matrix(r["values"], len(ids), r["dims"]))
                score = np.where(ids[None, :] == names[:, None], np.iinfo(np.int64).min, score)
                least = np.sort(score, axis=1)[:, -k] if len(ids) >= k else np.full(len(names), np.iinfo(np.int64).min)
                out.append((r["part"], r["rows"], least.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "rows", "kth"])

    return run


def _surviving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, n): blocks whose bound reaches the seeded score of a query of the part."""
    for part, numbers, bounds in _several(batches):
        keep = (bounds >= part["least"][:, None]).any(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([part["part"]] * int(keep.sum()), pa.int64()), pa.array(np.array(numbers)[keep])], ["part", "n"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, least): the greatest kth scores of a part's queries in their order; rows are sorted by part."""
    for group in sorted_groups(batches, ["part"]):
        rows = np.concatenate([np.frombuffer(x, np.int32) for x in group["rows"].to_pylist()])
        least = np.full(int(rows.max()) + 1, np.iinfo(np.int64).min)
        np.maximum.at(least, rows, np.concatenate([np.frombuffer(x, np.int64) for x in group["kth"].to_pylist()]))
        yield pa.RecordBatch.from_arrays([pa.array([group["part"][0].as_py()]), pa.array([least.tobytes()], pa.binary())], ["part", "least"])


def _searched(k: int):
    """The best of each query over rows sorted by part and shard: a part of queries and the forward indexes of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["part", "shard"]):
            blocks, asked = [], None
            for r in group.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                values = _matrix(r["values"], len(ids), r["dims"])
                if r["query"]:
                    asked = values, ids, np.frombuffer(r["least"], np.int64)
                else:
                    blocks.append((ids, values, *(_matrix(r[x], 1, r["dims"])[0] for x in ("top", "low"))))
            if asked is None or not blocks:
                continue
            found, _ = search(*asked, blocks, k)
            if found:
                n = [len(ids) for _, ids, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked[1][[i for i, _, _ in found]], n)), pa.array(np.concatenate([x for _, x, _ in found])), pa.array(np.concatenate([x for _, _, x in found]))], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k greatest integer inner products, ties to the smaller vec_id.

    Both frames have vec_id and embedding; a component x counts as floor(scale * x). A query meets every row with
    another vec_id and as many dimensions; rows that repeat a vec_id count each. Null ids, and vectors that are null,
    empty or hold null or non-finite components, take no part; of repeated query ids the greatest embedding counts.
    Components beyond +-2**62 and scores beyond a long are moved to these bounds. Queries without candidates, and empty
    tables, give no rows. Other columns are ignored.
    """
    width = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def blocked(df: DataFrame, size: int, parts: int) -> DataFrame:
        rows = df.select("vec_id", "embedding").repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id")
        return cut(mapped(rows, _blocks(size, scale), "dims int, ids binary, values binary, top binary, low binary").withColumn("n", F.monotonically_increasing_id()))

    index = blocked(vectors, BLOCK, width)
    once = queries.filter("vec_id is not null").groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
    asked = blocked(once, QUERIES, max(1, -(-once.count() // QUERIES))).withColumnRenamed("n", "part")
    parts = asked.select("part", "dims")  # a row per part
    none = F.lit(None).cast("binary")

    def beside(asked: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
        """Parts of queries and blocks, dealt and sorted by the keys, a part before its blocks."""
        both = asked.select(*keys, F.lit(True).alias("query"), F.lit(None).cast("long").alias("n"), "dims", "ids", "values", none.alias("top"), none.alias("low"), "least").unionByName(
            blocks.select(*keys, F.lit(False).alias("query"), "n", "dims", "ids", "values", "top", "low", none.alias("least"))
        )
        return both.repartition(width, *keys).sortWithinPartitions(*keys, F.desc("query"), "n")

    # every part sees the summaries of all blocks of its dimensions, in slices
    slices = max(1, -(-index.count() // SLICE), -(-width // max(1, parts.count())))
    sliced = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    heads = index.select("n", "dims", none.alias("ids"), none.alias("values"), "top", "low", F.pmod(F.xxhash64("n"), F.lit(slices)).cast("int").alias("slice"))
    heads = heads.join(F.broadcast(parts), "dims")  # 12 bytes a part, of thousands of queries each
    keys = ["part", "slice"]
    seeds = mapped(beside(asked.select("*", none.alias("least"), sliced.alias("slice")), heads, keys), _seeded, "part long, n long, rows binary, asked binary, names binary")
    kth = mapped(seeds.join(index.select("n", "dims", "ids", "values"), "n"), _kth(k), "part long, rows binary, kth binary")
    least = mapped(kth.repartition(width, "part").sortWithinPartitions("part"), _joined, "part long, least binary")
    asked = cut(asked.join(least, "part"))
    kept = mapped(beside(asked.select("*", sliced.alias("slice")), heads, keys), _surviving, "part long, n long").withColumn("shard", F.floor(F.row_number().over(Window.partitionBy("part").orderBy("n")) / SHARD))
    kept = cut(kept)
    shards = kept.select("part", "shard").distinct()
    found = mapped(beside(asked.join(shards, "part"), index.join(kept, "n"), ["part", "shard"]), _searched(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
