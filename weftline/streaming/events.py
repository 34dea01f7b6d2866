"""Event-time windows, sessions, first-seen keys and rules over streams or tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """Per window and type: n, total."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Per user, runs of events less than ``gap`` apart: start, n."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def first_seen(rows: DataFrame, key: str, late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def checked(stream: DataFrame, rules: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Applies batch rules to each micro-batch and appends the diagnostics; a batch that is run again replaces its own."""

    def one(batch: DataFrame, number: int) -> None:
        rules(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
