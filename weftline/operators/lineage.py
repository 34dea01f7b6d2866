"""Cutting lineage with files that every executor can read again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The session's checkpoint folder, which the driver and all executors share.

    Where none is set, a session on one machine (master local) gets a temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weftline-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder and read from there."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)
