"""Module tables on disk, partitioned by module: re-ingest and upsert rewrite the partitions they touch and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.lineage import cut
from weftline.sources import store

SPLITS = 16  # files of a module at most, so that a large one isn't one task's


def save(rows: DataFrame, path: str, by: str = "module", mode: str = "overwrite") -> None:
    """Writes the whole table, or with mode ``dynamic`` the partitions that ``rows`` has."""
    dealt = rows.repartition(F.col(by), F.pmod(F.xxhash64(*(c for c in rows.columns if c != by)), F.lit(SPLITS)))
    option = {"partitionOverwriteMode": "dynamic" if mode == "dynamic" else "static"}
    dealt.write.mode("overwrite").options(**option).partitionBy(by).parquet(path)


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table in the given schema; a folder without partitions has no rows."""
    return spark.read.schema(schema).parquet(path)


def _drop(spark: SparkSession, path: str, by: str, values: list) -> None:
    """Removes the partitions of these values."""
    jvm = spark.sparkContext._jvm
    for value in values:
        name = "__HIVE_DEFAULT_PARTITION__" if value is None else jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(value))
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={name}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def replace_modules(spark: SparkSession, path: str, new: DataFrame, modules: list[str], by: str = "module") -> None:
    """Re-ingest on disk: the named modules' rows give way to those of ``new``, which has no other modules' rows; a module without new rows goes.

    Running it again leaves the same rows.
    """
    rows = cut(new)
    other = rows.filter(~F.coalesce(F.col(by).isin(modules), F.lit(False))).limit(1).count()
    if other:
        raise ValueError("rows of modules that aren't re-ingested")
    left = {r[0] for r in rows.select(by).distinct().collect()}  # at most the named modules
    save(rows, path, by, "dynamic")
    _drop(spark, path, by, [m for m in modules if m not in left])


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str, by: str = "module") -> None:
    """Upsert on disk: ``store.upsert`` over the partitions that hold a key of ``new`` or get one of its rows.

    A row may move to another module; a module that loses its last row goes. ``new`` has each key once. Running it again leaves the same rows.
    """
    new = cut(new)
    table = read(spark, path, new.schema)
    touched = table.join(new.select(key), key, "left_semi").select(by).unionByName(new.select(by)).distinct().withColumnRenamed(by, "_touched")
    held = table.join(touched, table[by].eqNullSafe(touched["_touched"]), "left_semi")
    rows = cut(store.upsert(held, new, key))  # written before the partitions that it reads are overwritten
    empty = [r[0] for r in touched.join(rows, touched["_touched"].eqNullSafe(rows[by]), "left_anti").collect()]  # modules that lost all rows
    save(rows, path, by, "dynamic")
    _drop(spark, path, by, empty)
