"""A sink of requests: a Python data source whose writer sends numbered batches with retries and reports what was refused.

A row is a request: ``batch`` (its number, the same however often a task runs) and ``payload`` (a JSON array of records), as ``store.batches`` makes them.
The sender, named by the option ``sender`` as ``module:factory``, is made in each task from the options and has ``send(key, records)``. It takes a key twice only once:
the key is the job's name and the batch number, so a task that runs again, or a request whose answer was lost, doubles nothing.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from weftline.sources import store

MOST_RECORDS, TRIES, PAUSE = 200, 4, 2.0  # fixed values: records of a request, tries of a request, seconds before the second try


class Refused(Exception):
    """The sender's answer to a request that will never be taken."""


@dataclass
class Sent(WriterCommitMessage):
    """What a task has sent: numbers of requests and records, and (batch, tries, error) of each refused request."""

    requests: int = 0
    records: int = 0
    refused: list[tuple[int, int, str]] = field(default_factory=list)


class RequestWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self._options = dict(options)

    def _sender(self):
        module, _, factory = self._options["sender"].partition(":")
        return getattr(importlib.import_module(module), factory)(self._options)

    def write(self, iterator: Iterator[Row]) -> Sent:
        """Sends each row; connection errors and timeouts are tried TRIES times with pauses that double."""
        sender, out = self._sender(), Sent()
        pause = float(self._options.get("pause", PAUSE))
        for row in iterator:
            records = json.loads(row["payload"])
            if len(records) > MOST_RECORDS:
                raise ValueError(f"{len(records)} records in batch {row['batch']}")
            error = ""
            for attempt in range(1, TRIES + 1):
                try:
                    sender.send(f"{self._options['job']}/{row['batch']}", records)
                    out.requests, out.records = out.requests + 1, out.records + len(records)
                    break
                except Refused as refusal:
                    out.refused.append((row["batch"], attempt, str(refusal)))
                    break
                except (ConnectionError, TimeoutError) as failure:
                    error = f"{type(failure).__name__}: {failure}"
                if attempt == TRIES:
                    out.refused.append((row["batch"], TRIES, error))
                else:
                    time.sleep(pause * 2 ** (attempt - 1))
        return out

    def commit(self, messages: list[Sent | None]) -> None:
        """Writes the log, a JSON line per refused request and one of totals, where the option ``log`` says (a path that Arrow's file systems know)."""
        from pyarrow import fs

        sent = [m for m in messages if m is not None]
        refused = sorted(r for m in sent for r in m.refused)
        lines = [{"job": self._options["job"], "batch": b, "tries": t, "error": e} for b, t, e in refused]
        lines.append({"job": self._options["job"], "requests": sum(m.requests for m in sent), "records": sum(m.records for m in sent), "refused": len(refused)})
        if "log" in self._options:
            system, path = fs.FileSystem.from_uri(self._options["log"])
            system.create_dir(path, recursive=True)
            with system.open_output_stream(f"{path}/{self._options['job'].replace('/', '-')}.jsonl") as out:
                out.write("".join(json.dumps(x) + "\n" for x in lines).encode())

    def abort(self, messages: list[Sent | None]) -> None:
        """Nothing is taken back: what was sent keeps its keys, so the same job run again completes it."""


class RequestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weftline_requests"

    def schema(self) -> str:
        return "batch long, payload string"

    def writer(self, schema, overwrite: bool) -> RequestWriter:
        for name in ("sender", "job"):
            if name not in self.options:
                raise ValueError(f"the option {name} is missing")
        return RequestWriter(self.options)


LOG = "job string, batch long, tries int, error string, requests long, records long, refused long"


def upload(spark: SparkSession, tables: dict[str, DataFrame], order: list[str], key: str, sender: str, job: str, log: str, options: dict[str, str] | None = None) -> DataFrame:
    """Sends all rows of the tables, parents before children, in requests of MOST_RECORDS records; returns the log (LOG).

    Each table has a column ``key`` with distinct values, by which its records are numbered; a table is sent once the one before it has ended. Null keys come first, an
    empty table is one job without requests. Running the same job again sends the same requests under the same keys.
    """
    spark.dataSource.register(RequestSource)
    for name in order:
        requests = store.batches(tables[name], [key], F.struct("*"), MOST_RECORDS).select("batch", "payload")
        requests.write.format(RequestSource.name()).mode("append").options(**(options or {}), sender=sender, job=f"{job}/{name}", log=log).save()
    logs = [spark.read.schema(LOG).json(f"{log}/{job.replace('/', '-')}-{name}.jsonl") for name in order]
    return reduce(DataFrame.unionByName, logs)
