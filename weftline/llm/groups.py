"""Streaming over sorted groups inside a task, and connected components between rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.session import cut

HOT = 500


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Each run of rows with equal keys as one table; the rows come sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        start = 0
        for i, key in enumerate(zip(*columns, strict=True)):
            if key != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, key
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root) of every node that has an edge and is not the least of its component.

    ``edges`` has the columns a and b. Alternates the large-star and small-star steps until the edges
    are stars around least nodes; each step is an aggregation with map-side minima and an equi-join, and each
    round is checkpointed. The minima of nodes that have over a HOT-th of all ends, of which there can be only HOT, are
    broadcast, so that no task gets all edges of a hub. Null ends and loops are left out; no edges give no rows.
    """
    now = cut(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        turned = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
        both = now.select(F.inline(F.array(F.struct("a", "b"), turned)))
        ends = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"), F.count_if(F.col("b") < F.col("a")).alias("up")).persist()
        most, total, open_ends = ends.agg(F.max("n"), F.sum("n"), F.count_if(F.expr("up > 1 or up = 1 and n > 1"))).first()
        if not open_ends:
            ends.unpersist()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        large = _told(now, ends.select(F.col("a").alias("b"), F.least("a", "m").alias("m"), "n"), most, total / HOT).select("a", F.col("m").alias("b"))
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        now = cut(small.select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).filter("a <> b").distinct())
        ends.unpersist()
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _told(edges: DataFrame, least: DataFrame, most: int, many: float) -> DataFrame:
    """``edges`` with the minimum m of their end b; minima of ends with over ``many`` edges, fewer than HOT, are broadcast.

    Edges of such a hub are dealt by their other end, and meet nothing in the join of the rest.
    """
    if most <= many:
        return edges.join(least.drop("n"), "b")
    hubs = least.filter(F.col("n") > many).select("b", F.col("m").alias("hub_m"))
    told = edges.join(F.broadcast(hubs), "b", "left").withColumn("at", F.when(F.col("hub_m").isNull(), F.col("b")).otherwise(F.col("a"))).withColumn("hub", F.col("hub_m").isNotNull())
    rest = least.filter(F.col("n") <= many).select(F.col("b").alias("at"), F.lit(False).alias("hub"), "m")
    return told.join(rest, ["at", "hub"], "left").select("a", "b", F.coalesce("hub_m", "m").alias("m"))
