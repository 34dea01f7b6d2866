"""Session matters that the operators share: cutting lineage, Arrow functions and tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.bytetext import tidy

BATCH_ROWS = 1000  # of an Arrow batch, where the session has Spark's own 10,000: texts may be long


def folder(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``, or that its context has been given.

    Where neither is set, a session on one machine (master local) gets a temporary folder; on a cluster that is an error.
    """
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = own.get() if own.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="weftline-checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read from there, and its path for ``dropped``; smaller than a checkpoint, for tables of many short rows."""
    path = f"{folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a stored table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` by a function that is tidy about memory, over batches of BATCH_ROWS unless the session has a number of its own."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(tidy(run), schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
