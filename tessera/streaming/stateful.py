"""Streams whose keys keep state and wake up by themselves: leases of jobs, and the names that files define.

State lies in RocksDB and in the query's checkpoint, so a restarted query goes on where the last batch ended.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.schema import LEASE_SECONDS
from tessera.streaming.jobs import next_state

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LeasedJobs(StatefulProcessor):
    """A job's status and attempts. A claim sets a timer; when it goes off before the job has ended, its worker counts as lost and the job is pending again."""

    def __init__(self, key: str, order: list[str], kind: str, lease_seconds: int):
        self.key, self.order, self.kind, self.lease = key, order, kind, 1000 * lease_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, attempts bigint, lapses bigint")

    def _held(self) -> tuple:
        return tuple(self.job.get()) if self.job.exists() else (None, 0, 0)

    def _told(self, key: tuple, status: str, attempts: int, released: bool) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "status": [status], "attempts": [attempts], "released": [released]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, attempts, lapses = self._held()
        for event in pd.concat(list(rows)).sort_values(self.order)[self.kind]:
            claimed = status != "processing"
            status, attempts = next_state(status, attempts, event)
            if status == "processing" and claimed:
                lapses = int(time.time() * 1000) + self.lease
            elif status != "processing":
                lapses = 0
        for timer in list(self.handle.listTimers()):
            if timer != lapses:
                self.handle.deleteTimer(timer)
        if lapses:
            self.handle.registerTimer(lapses)
        self.job.update((status, attempts, lapses))
        if status is not None:
            yield self._told(key, status, attempts, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, attempts, lapses = self._held()
        if status == "processing" and lapses <= expiredTimerInfo.getExpiryTimeInMs():
            self.job.update(("pending", attempts, 0))
            yield self._told(key, "pending", attempts, True)

    def close(self) -> None:
        pass


def leased_jobs(events: DataFrame, key: str, order: list[str], kind: str, lease_seconds: int = LEASE_SECONDS) -> DataFrame:
    """(key, status, attempts, released) of the jobs that a micro-batch touches, and of those whose claim ran out."""
    events.sparkSession.conf.set(_PROVIDER, _ROCKSDB)
    schema = f"{key} {events.schema[key].dataType.simpleString()}, status string, attempts long, released boolean"
    return events.select(key, *order, kind).groupBy(key).transformWithStateInPandas(LeasedJobs(key, order, kind, lease_seconds), schema, "Update", "ProcessingTime")


class KnownNames(StatefulProcessor):
    """The names that a file defined when it was last seen; rows tell which came and which went since."""

    def __init__(self, order: list[str]):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.names = handle.getValueState("names", "names array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = set(self.names.get()[0]) if self.names.exists() else set()
        last = pd.concat(list(rows)).sort_values(self.order)["names"].iloc[-1]
        after = set() if last is None else {n for n in last if n}
        if after:
            self.names.update((sorted(after),))
        elif before:
            self.names.clear()
        told = [(n, "came") for n in sorted(after - before)] + [(n, "went") for n in sorted(before - after)]
        if told:
            yield pd.DataFrame({"file_path": key[0], "name": [n for n, _ in told], "change": [c for _, c in told]})

    def close(self) -> None:
        pass


def name_deltas(snapshots: DataFrame, order: list[str]) -> DataFrame:
    """(file_path, name, change) from snapshots (file_path, names): the names of a file as it is now, null or empty once it is gone."""
    snapshots.sparkSession.conf.set(_PROVIDER, _ROCKSDB)
    return snapshots.select("file_path", "names", *order).groupBy("file_path").transformWithStateInPandas(KnownNames(order), "file_path string, name string, change string", "Append", "None")
