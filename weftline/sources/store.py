"""A token store as DataFrames: each operation returns the table it leaves, and what it refused."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.lineage import cut


def insert_tokens(store: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(store, rejected): keys that the store has, and repeats within the new rows but for the least, are refused."""
    ranked = new.withColumn("_k", F.row_number().over(Window.partitionBy("token_sha").orderBy(*(c for c in new.columns if c != "token_sha"))))
    held = store.select("token_sha")
    fresh = ranked.filter("_k = 1").drop("_k").join(held, "token_sha", "left_anti")
    rejected = ranked.filter("_k > 1").drop("_k").unionByName(ranked.filter("_k = 1").drop("_k").join(held, "token_sha", "left_semi"))
    return store.unionByName(fresh), rejected


def delete_tokens(store: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(store, edges) without the tokens of ``gone`` (token_sha) and their edges."""
    keys = gone.select("token_sha").distinct()
    kept = edges.join(keys.withColumnRenamed("token_sha", "source_sha"), "source_sha", "left_anti").join(keys.withColumnRenamed("token_sha", "target_sha"), "target_sha", "left_anti")
    return store.join(keys, "token_sha", "left_anti"), kept.select(edges.columns)


def update_weights(store: DataFrame, weights: DataFrame) -> DataFrame:
    new = weights.select("token_sha", F.col("weight").alias("_weight"))
    return store.join(new, "token_sha", "left").withColumn("weight", F.coalesce("_weight", "weight")).select(store.columns)


def insert_edges(edges: DataFrame, new: DataFrame, store: DataFrame) -> DataFrame:
    """Edges whose ends both exist and that aren't there yet join; of a repeated new edge the one of the least weight counts, of one that is there already the weight there stays."""
    keys = store.select("token_sha")
    known = new.join(keys.withColumnRenamed("token_sha", "source_sha"), "source_sha", "left_semi").join(keys.withColumnRenamed("token_sha", "target_sha"), "target_sha", "left_semi")
    pk = ["source_sha", "target_sha", "rel_type"]
    least = known.withColumn("_k", F.row_number().over(Window.partitionBy(*pk).orderBy("weight", *(c for c in new.columns if c not in (*pk, "weight"))))).filter("_k = 1").drop("_k")
    return edges.unionByName(least.join(edges.select(pk), pk, "left_anti").select(edges.columns))


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table with the new rows in place of those of the same key."""
    return table.join(new.select(key), key, "left_anti").select(table.columns).unionByName(new.select(table.columns))


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("module").agg(F.count("*").alias("page_count"))


def replace_module(table: DataFrame, new: DataFrame, module: str) -> DataFrame:
    """Re-ingest: all rows of a module give way to the new ones."""
    return table.filter(~F.col("module").eqNullSafe(F.lit(module))).unionByName(new.select(table.columns))


def purged(store: DataFrame) -> tuple[DataFrame, int]:
    """The store without its tokens, and how many went."""
    return store.filter("false"), store.count()


def exported(rows: DataFrame, database: str) -> DataFrame:
    return rows.select(F.to_json(F.struct("*", F.lit(database).alias("database"))).alias("json"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place in the order, from 0, as a long column ``name``.

    Rows are numbered in ranges of the order: a range's rows by a window, its start by the ranges' counts.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once: another run of the range exchange may cut the ranges elsewhere
    ranged = cut(rows.repartitionByRange(width, *order).withColumn("_part", F.spark_partition_id()))
    counted = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counted.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per partition
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_k", number).join(F.broadcast(starts), "_part").withColumn(name, F.col("_k") + F.col("_before")).drop("_k", "_part", "_before")


def ordered_batches(tables: dict[str, DataFrame], order: list[str], key: str, size: int = 200) -> DataFrame:
    """place, table_name, batch, n_records, payload of all tables in the order of upload (parents first); each has a column ``key``."""
    parts = [batches(tables[n], [key], F.struct("*"), size).select(F.lit(i).alias("place"), F.lit(n).alias("table_name"), "batch", "n_records", "payload") for i, n in enumerate(order)]
    return reduce(DataFrame.unionByName, parts)


def batches(rows: DataFrame, order: list[str], record: Column, size: int = 200) -> DataFrame:
    """batch, n_records, payload: requests of ``size`` records in order, for a sink that takes no more at once."""
    placed = numbered(rows.select(*order, record.alias("_record")), order, "_i").withColumn("batch", F.floor(F.col("_i") / size).cast("long"))
    return placed.groupBy("batch").agg(F.count("*").alias("n_records"), F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_record"))), lambda r: r["_record"])).alias("payload"))
