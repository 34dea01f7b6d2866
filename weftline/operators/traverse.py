"""Traversal and ranking over edges (source_sha, target_sha, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.lineage import cut


def counts(tokens: DataFrame, edges: DataFrame) -> DataFrame:
    """n_nodes (tokens and ends of edges), n_edges."""
    nodes = tokens.select("token_sha").union(edges.select("source_sha")).union(edges.select("target_sha")).distinct()
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges")))  # one row each


def neighbours(edges: DataFrame, node: str, most: int = 1024) -> DataFrame:
    return edges.filter(F.col("source_sha") == node).select("target_sha", "weight").orderBy("target_sha").limit(most)


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source_sha").agg(F.count("*").alias("out_degree"))


def bfs(edges: DataFrame, start: DataFrame, most_depth: int | None = None) -> DataFrame:
    """node, depth of all nodes reachable along edges from ``start`` (node), each at its least depth.

    One level is one join with the edges and one anti-join with the nodes seen; levels go on until
    none is new or ``most_depth`` is reached. Only whether a level is empty comes to the driver.
    """
    out = edges.select(F.col("source_sha").alias("node"), F.col("target_sha").alias("to"))
    seen = front = cut(start.select("node").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while most_depth is None or depth < most_depth:
        depth += 1
        front = cut(front.join(out, "node").select(F.col("to").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front)) if depth % 5 == 0 else seen.unionByName(front)
    return seen


def pagerank(edges: DataFrame, nodes: DataFrame, rounds: int = 20, damping: float = 0.85, chunk: int = 4096) -> DataFrame:
    """node, rank: unweighted, parallel edges count each, and the rank of nodes without outgoing edges is dropped, so ranks need not sum to 1.

    A node's links are kept as arrays of about ``chunk`` targets, by (node, part), so that a node with a third of all links is many rows; they
    don't move again. A round sends by how much ranks have changed, so nodes whose rank stays send nothing, and rounds end early where all stay
    (behind the longest path of a graph without cycles): each further round would give the same ranks.
    """
    counted = cut(edges.groupBy(F.col("source_sha").alias("node"), F.col("target_sha").alias("to")).agg(F.count("*").alias("times")))
    degree = counted.groupBy("node").agg(F.sum("times").alias("degree"), F.ceil(F.count("*") / chunk).cast("int").alias("parts"))
    given = counted.join(degree, "node").select("node", F.pmod(F.xxhash64("to"), F.col("parts")).cast("int").alias("part"), "to", (damping * F.col("times") / F.col("degree")).alias("share"))
    state = cut(nodes.select("node").distinct().join(degree.select("node", "parts"), "node", "left").select("node", F.coalesce("parts", F.lit(0)).alias("parts")))
    n = max(1, state.count())
    links = cut(given.groupBy("node", "part").agg(F.collect_list(F.struct("to", "share")).alias("targets")))
    ranks = state.withColumn("rank", F.lit(1.0 / n)).withColumn("change", F.lit(1.0 / n))
    for i in range(rounds):
        sent = ranks.filter("change is not null and parts > 0").select("node", "change", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(links, ["node", "part"])
        got = sent.select("change", F.inline("targets")).groupBy(F.col("to").alias("node")).agg(F.sum(F.col("change") * F.col("share")).alias("got"))
        met = ranks.join(got, "node", "left")
        if i == 0:  # all that a node has got so far, from the even start
            rank = F.lit((1 - damping) / n) + F.coalesce("got", F.lit(0.0))
            ranks = cut(met.select("node", "parts", rank.alias("rank"), (rank - F.col("rank")).alias("change")))
        else:
            ranks = cut(met.select("node", "parts", (F.col("rank") + F.coalesce("got", F.lit(0.0))).alias("rank"), F.col("got").alias("change")))
        if i + 1 < rounds and ranks.filter("change is not null and parts > 0").isEmpty():
            break
    return ranks.select("node", "rank")


def parents_of(keys: DataFrame, form: str) -> DataFrame:
    return keys.filter(F.col("child_form") == form).select("parent_form").distinct()


def children_of(keys: DataFrame, form: str) -> DataFrame:
    return keys.filter(F.col("parent_form") == form).select("child_form").distinct()


def load_order(keys: list[tuple[str, str]]) -> list[str]:
    """Forms so that parents come before children, by (child, parent) pairs of a schema; ties by name. A cycle raises."""
    forms = sorted({f for pair in keys for f in pair})
    wants = {f: {p for c, p in keys if c == f and p != f} for f in forms}
    order: list[str] = []
    while wants:
        ready = [f for f in forms if f in wants and not wants[f] - set(order)]
        if not ready:
            raise ValueError(f"foreign keys form a cycle among {sorted(wants)}")
        order.append(ready[0])
        del wants[ready[0]]
    return order


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, level of ``nodes`` (node) and all ends of ``edges`` (node, needs): 0 without needs, else one above the greatest of what is needed; null in a cycle or behind one.

    One level is an anti-join of the open nodes with the edges whose need isn't placed yet. Repeated edges count once, an edge to itself doesn't count, null ends are left out.
    Only whether a level is empty comes to the driver.
    """
    plain = edges.filter("node is not null and needs is not null")
    left = cut(nodes.filter("node is not null").select("node").union(plain.select("node")).union(plain.select("needs")).distinct())
    open_ = cut(plain.filter("node <> needs").select("node", "needs").distinct())
    done, level = None, 0
    while True:
        ready = cut(left.join(open_, "node", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        left = cut(left.join(ready, "node", "left_anti"))
        open_ = cut(open_.join(ready.select(F.col("node").alias("needs")), "needs", "left_anti").select("node", "needs"))
        level += 1
    rest = left.withColumn("level", F.lit(None).cast("int"))
    return rest if done is None else done.unionByName(rest)


def cycles(edges: DataFrame) -> DataFrame:
    """cycle, node of every node that can reach itself by way of another one: strongly connected nodes of ``edges`` (node, needs), named after the least of them.

    In each round nodes without a way in or out go first. Then every node learns the least node that reaches it (in every other round the greatest),
    which parts the rest into colours; edges between colours are on no cycle and go. What reaches its colour's node within the colour is strongly connected
    with it, and leaves. Where needs have smaller names (or all have greater ones) few rounds are left, however long the paths are. Each step is a join and
    an aggregation; whether anything is left comes to the driver.
    """
    left = cut(edges.filter("node <> needs").select(F.col("node").alias("a"), F.col("needs").alias("b")).distinct())
    found, least = None, True
    while not left.isEmpty():
        inner = left.select(F.col("a").alias("n")).distinct().join(left.select(F.col("b").alias("n")).distinct(), "n")
        left = cut(left.join(inner.withColumnRenamed("n", "a"), "a", "left_semi").join(inner.withColumnRenamed("n", "b"), "b", "left_semi").select("a", "b"))
        best, better = (F.min, F.least) if least else (F.max, F.greatest)
        colour = cut(left.select(F.col("a").alias("n")).union(left.select("b")).distinct().withColumn("c", F.col("n")).withColumn("new", F.lit(True)))
        while True:  # only what has changed is told on
            told = left.join(colour.filter("new").select(F.col("n").alias("a"), "c"), "a").groupBy(F.col("b").alias("n")).agg(best("c").alias("d"))
            chosen = better("c", F.coalesce("d", "c"))
            colour = cut(colour.select("n", "c").join(told, "n", "left").select("n", chosen.alias("c"), (chosen != F.col("c")).alias("new")))
            if colour.filter("new").isEmpty():
                break
        start, end = colour.select(F.col("n").alias("a"), F.col("c").alias("ca")), colour.select(F.col("n").alias("b"), F.col("c").alias("cb"))
        same = cut(left.join(start, "a").join(end, "b").filter("ca = cb").select("a", "b", "ca"))
        strong = front = cut(colour.filter("n = c").select("n", "c"))
        while True:
            front = cut(same.join(front.select(F.col("n").alias("b")), "b").select(F.col("a").alias("n"), F.col("ca").alias("c")).distinct().join(strong, "n", "left_anti"))
            if front.isEmpty():
                break
            strong = cut(strong.unionByName(front))
        size = strong.groupBy("c").agg(F.min("n").alias("cycle"), F.count("*").alias("size")).filter("size > 1")
        named = strong.join(size, "c").select("cycle", F.col("n").alias("node"))
        found = named if found is None else found.unionByName(named)
        gone = strong.select("n")
        left = cut(same.select("a", "b").join(gone.withColumnRenamed("n", "a"), "a", "left_anti").join(gone.withColumnRenamed("n", "b"), "b", "left_anti").select("a", "b"))
        least = not least
    if found is None:
        return edges.select(F.col("node").alias("cycle"), "node").filter("false")
    return cut(found)
