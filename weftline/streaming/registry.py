"""The registry of token keys over a stream: which database holds a key, what is refused, leases that run out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DECIDED = "token_sha string, db string, op string, ts timestamp, n long, accepted boolean, reason string"


class Registry(StatefulProcessor):
    """State of a key: the database that holds it, and until when in milliseconds (0: for good)."""

    def __init__(self, leases: dict[str, int]):
        self._leases = leases

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._owner = handle.getValueState("owner", "db string, until long")

    def _held(self) -> tuple[str, int] | None:
        return tuple(self._owner.get()) if self._owner.exists() else None

    def _hold(self, db: str, ts: pd.Timestamp) -> None:
        until = int(ts.timestamp() * 1000) + 1000 * self._leases[db] if db in self._leases else 0
        self._owner.update((db, until))
        if until:
            self._handle.registerTimer(until)

    def _release(self) -> None:
        held = self._held()
        if held and held[1]:
            self._handle.deleteTimer(held[1])
        self._owner.clear()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        first = initialState.iloc[0]
        self._hold(first["db"], first["ts"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            part = part.sort_values(["ts", "n", "db", "op"], kind="stable")
            said = []
            for row in part.itertuples():
                held = self._held()
                if held and held[1] and row.ts.timestamp() * 1000 >= held[1]:
                    self._release()
                    held = None
                if row.op == "create":
                    said.append(f"held by {held[0]}" if held else "")
                    if not held:
                        self._hold(row.db, row.ts)
                elif row.op == "destroy":
                    said.append("" if held else "not found")
                    if held:
                        self._release()
                else:
                    said.append("unknown operation")
            yield part.assign(accepted=[not s for s in said], reason=said)[["token_sha", "db", "op", "ts", "n", "accepted", "reason"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._held()
        if held and held[1] and held[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self._owner.clear()
        return iter(())

    def close(self) -> None:
        pass


def registered(operations: DataFrame, held: DataFrame | None = None, leases: dict[str, int] | None = None, late: str = "1 hour") -> DataFrame:
    """``operations`` (token_sha, db, op, ts, n) of a stream with accepted and reason, in the order of ts and n for each key.

    create takes a key that no database holds and is refused otherwise, by the same database too; destroy lets go of a held key.
    ``held`` (token_sha, db, ts) is what the databases have at the start. Keys of a database in ``leases`` are let go of after so many
    seconds of event time: an operation behind that moment finds the key free, and a timer drops its state once the watermark is there.
    Operations behind the watermark of a registry with leases are dropped, as streams do; without leases none are. Null keys are refused. Of one key's operations in a micro-batch, every
    Arrow batch is taken in order, and batches as they come.
    """
    spark = operations.sparkSession
    if "HDFSBackedStateStoreProvider" in (spark.conf.get(STORE, None) or "HDFSBackedStateStoreProvider"):
        spark.conf.set(STORE, ROCKS)  # the only one that holds such state
    rows = operations.select("token_sha", "db", "op", "ts", "n")
    if leases:
        rows = rows.withWatermark("ts", late)
    start = held.select("token_sha", "db", "ts").groupBy("token_sha") if held is not None else None
    decided = rows.filter("token_sha is not null").groupBy("token_sha").transformWithStateInPandas(
        statefulProcessor=Registry(leases or {}), outputStructType=DECIDED, outputMode="Append", timeMode="EventTime" if leases else "None", initialState=start
    )
    if leases:
        return decided
    return decided.unionByName(rows.filter("token_sha is null").select("*", F.lit(False).alias("accepted"), F.lit("no key").alias("reason")))
