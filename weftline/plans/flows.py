"""Queries over dependencies, bounded loops, attempts and sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import loops, sketches, traverse

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_NEEDS = """e AS (SELECT doc_id AS node, doc_id // 2 AS needs FROM documents WHERE doc_id > 0 UNION SELECT d.doc_id + k, d.doc_id + (k + 1) % 3 FROM documents d, (VALUES (0), (1), (2)) v(k) WHERE d.doc_id % 50 = 10)"""


def _needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document needs that of half its id, and every fiftieth three ones need one another in a ring."""
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    half = ids.filter("doc_id > 0").selectExpr("doc_id as node", "doc_id div 2 as needs")
    ring = ids.filter("doc_id % 50 = 10").selectExpr("doc_id", "explode(array(0, 1, 2)) as k").selectExpr("doc_id + k as node", "doc_id + (k + 1) % 3 as needs")
    return half.unionByName(ring)


@query(f"""WITH RECURSIVE {_NEEDS}, stuck(node) AS (SELECT DISTINCT d.doc_id + k FROM documents d, (VALUES (0), (1), (2)) v(k) WHERE d.doc_id % 50 = 10 UNION SELECT e.node FROM e JOIN stuck s ON e.needs = s.node),
        n AS (SELECT node FROM e UNION SELECT needs FROM e UNION SELECT doc_id FROM documents),
        l(node, level) AS (SELECT node, 0 FROM n WHERE node NOT IN (SELECT node FROM e) UNION ALL SELECT e.node, level + 1 FROM e JOIN l ON e.needs = l.node WHERE e.node NOT IN (SELECT node FROM stuck))
    SELECT n.node, l.level FROM n LEFT JOIN l USING (node)""")
def load_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels in which documents may be loaded; none for rings and what needs them."""
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id as node")
    return traverse.levels(_needs(spark, sf_dir), ids)


@query("SELECT DISTINCT d.doc_id AS cycle, d.doc_id + k AS node FROM documents d, (VALUES (0), (1), (2)) v(k) WHERE d.doc_id % 50 = 10")
def load_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rings, by member."""
    return traverse.cycles(_needs(spark, sf_dir))


@query("""WITH RECURSIVE r(o_orderkey, n, steps) AS (
        SELECT o_orderkey, o_orderkey, 0 FROM orders
        UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 500 = 3 THEN n WHEN n % 2 = 0 THEN n // 2 ELSE 3 * n + 1 END, steps + 1 FROM r WHERE n > 1 AND steps < 400
    ) SELECT o_orderkey, n, steps, CASE WHEN n > 1 THEN 'limit' ELSE 'done' END AS outcome FROM r QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY steps DESC) = 1""")
def bounded_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loop per order that halves even numbers and triples odd ones; some orders stand still and meet the bound."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderkey").alias("n"), (F.col("o_orderkey") % 500 == 3).alias("still"))

    def step(s):
        return {"n": F.when(s["still"], s["n"]).when(s["n"] % 2 == 0, F.floor(s["n"] / 2)).otherwise(3 * s["n"] + 1)}

    return loops.repeat_while(rows, ["n", "still"], lambda s: s["n"] > 1, step, 400).drop("still")


@query("""WITH t AS (SELECT *, l_linenumber % 3 AS d FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN d <> 0 AND l_quantity <= 45 THEN round(l_extendedprice / d, 4) END AS share, CASE WHEN l_quantity > 45 THEN 'cancelled' WHEN d = 0 THEN 'division' ELSE 'kept' END AS fate FROM t""")
def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large lines are cancelled, lines whose divisor is zero are rejected, the rest has a share."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    kept, gone = loops.cancelled(rows, F.col("l_quantity") > 45, "cancelled")
    good, bad = loops.tried(kept, {"share": F.round(F.try_divide(F.col("l_extendedprice"), F.col("l_linenumber") % 3), 4)}, "division")
    rejected = bad.unionByName(gone).select("l_orderkey", "l_linenumber", F.lit(None).cast("double").alias("share"), F.col("reason").alias("fate"))
    return good.select("l_orderkey", "l_linenumber", F.col("share").cast("double").alias("share"), F.lit("kept").alias("fate")).unionByName(rejected)


@query("SELECT l_linenumber, count(*) AS n, true AS near_hll, true AS near_theta FROM lineitem GROUP BY l_linenumber UNION ALL SELECT NULL, count(*), true, true FROM lineitem")
def group_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct orders by line number and of all lines, from merged sketches: whether the estimates are within 2 % of the exact counts."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linenumber", "l_orderkey")
    table = sketches.by_group(rows, "l_linenumber", "l_orderkey")
    both = table.unionByName(sketches.merged(table).withColumn("l_linenumber", F.lit(None).cast("int")))
    exact = rows.groupBy("l_linenumber").agg(F.count_distinct("l_orderkey").alias("exact")).unionByName(rows.agg(F.count_distinct("l_orderkey").alias("exact")).withColumn("l_linenumber", F.lit(None).cast("int")))
    found = sketches.estimated(both).withColumnRenamed("l_linenumber", "line")
    near = found.join(exact, F.col("line").eqNullSafe(F.col("l_linenumber")))
    return near.select("l_linenumber", "n", *((F.abs(F.col(f"distinct_{k}") / F.col("exact") - 1) <= 0.02).alias(f"near_{k}") for k in ("hll", "theta")))
