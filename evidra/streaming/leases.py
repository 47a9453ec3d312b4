"""Leases with timers: a running job whose worker stays silent is recovered without any further event.

The batch fold `operators.jobs` sees a lost worker only when the next claim comes. Here a lease registers a timer in event
time; when the watermark passes it, the job goes to RETRY_WAIT (1, 5, 15 minutes) or FAILED, its fence grows, so that the old
worker is shut out, and the pieces it had written are dropped. A second timer makes a job READY when its retry is due.
Events that come behind a deadline find it carried out, so that the states are those of `recovered`, the same in batch,
wherever the stream was cut into micro-batches or restarted.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.jobs import RETRY_MINUTES, step

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW = "status string, fence long, retries long, rejected long, expired long, dropped long"
BEGIN = (None, 0, 0, 0, None, None)


def _micros(x: dt.datetime | None) -> int:
    return -1 if x is None else int((x - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))


def _time(x: int) -> dt.datetime | None:
    return None if x < 0 else dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=x)


class Job:
    """A job's machine, the pieces written under its lease, and what its deadlines did."""

    def __init__(self, state: tuple = BEGIN, pieces: list[int] | None = None, expired: int = 0, dropped: int = 0):
        self.state, self.pieces, self.expired, self.dropped = state, pieces or [], expired, dropped

    @property
    def deadline(self) -> dt.datetime | None:
        """When the lease ends or the retry is due."""
        status, _, _, _, until, due = self.state
        return until if status == "RUNNING" else due if status == "RETRY_WAIT" else None

    def pass_time(self, now: dt.datetime) -> bool:
        """Carry out all deadlines before now."""
        moved = False
        while (at := self.deadline) is not None and at < now:
            status, fence, retries, rejected, _, _ = self.state
            if status == "RETRY_WAIT":
                self.state = ("READY", fence, retries, rejected, None, None)
            else:
                self.expired, self.dropped, self.pieces = self.expired + 1, self.dropped + len(self.pieces), []
                again = retries < len(RETRY_MINUTES)
                due = at + dt.timedelta(minutes=RETRY_MINUTES[retries]) if again else None
                self.state = ("RETRY_WAIT" if again else "FAILED", fence + 1, retries + again, rejected, None, due)
            moved = True
        return moved

    def take(self, event_id: int, kind: str, ts: dt.datetime | None, lease: dt.timedelta) -> None:
        if ts is not None:
            self.pass_time(ts)
        before, self.state = self.state, step(self.state, kind, ts, lease)
        if kind == "RENEW" and self.state != before and self.state[3] == before[3]:
            self.pieces.append(event_id)
        elif self.state[0] != "RUNNING":
            self.pieces = []

    @property
    def row(self) -> tuple:
        return (*self.state[:4], self.expired, self.dropped)


def recovered(events: DataFrame, now: dt.datetime, lease_minutes: int = 600) -> DataFrame:
    """(job_id, ROW) of events (job_id, event_id, ts, kind) with every deadline before now carried out: sorted logs as a stream."""
    kind = dict(events.dtypes)["job_id"]
    names = ["job_id", *(c.split()[0] for c in ROW.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lease, job, key = dt.timedelta(minutes=lease_minutes), Job(), []

        def closed() -> tuple:
            job.pass_time(now)
            return (key[0], *job.row)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (job_type, pa.string(), *[pa.int64()] * 5)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        for batch in batches:
            done, job_type = [], batch.column("job_id").type
            for k, event, what, ts in zip(*(batch.column(c).to_pylist() for c in ("job_id", "event_id", "kind", "ts")), strict=True):
                if key != [k]:
                    done += [closed()] if key else []
                    key, job = [k], Job()
                job.take(event, what, ts, lease)
            yield table(done)
        if key:
            yield table([closed()])

    rows = events.select("job_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "kind")
    return rows.repartition("job_id").sortWithinPartitions("job_id", "ts", "event_id").mapInArrow(run, f"job_id {kind}, {ROW}")


class _Leases(StatefulProcessor):
    """State of a key: its machine as one value, the pieces written under the lease as a list, one timer for the next deadline."""

    def __init__(self, lease_minutes: int):
        self.lease = dt.timedelta(minutes=lease_minutes)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", "status string, fence long, retries long, rejected long, until long, due long, expired long, dropped long")
        self.pieces = handle.getListState("pieces", "event_id long")

    def _load(self) -> Job:
        if not self.machine.exists():
            return Job()
        status, fence, retries, rejected, until, due, expired, dropped = self.machine.get()
        return Job((status, fence, retries, rejected, _time(until), _time(due)), [r[0] for r in self.pieces.get()], expired, dropped)

    def _store(self, key: tuple, job: Job) -> pd.DataFrame:
        s = job.state
        self.machine.update((s[0], *s[1:4], _micros(s[4]), _micros(s[5]), job.expired, job.dropped))
        self.pieces.clear()
        if job.pieces:
            self.pieces.put([(p,) for p in job.pieces])
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if job.deadline is not None:
            self.handle.registerTimer(_micros(job.deadline) // 1000 + 1)  # the first millisecond after it
        return pd.DataFrame([(key[0], *job.row)], columns=["job_id", *(c.split()[0] for c in ROW.split(", "))])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        log = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        job = self._load()
        for event, kind, ts in zip(log["event_id"], log["kind"], log["ts"], strict=True):
            job.take(int(event), kind, None if pd.isna(ts) else ts.tz_localize(None).to_pydatetime() if ts.tzinfo is None else ts.tz_convert("UTC").tz_localize(None).to_pydatetime(), self.lease)
        yield self._store(key, job)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job = self._load()
        job.pass_time(_time(1000 * timerValues.getCurrentWatermarkInMs()))
        yield self._store(key, job)

    def close(self) -> None:
        pass


def leased_jobs(events: DataFrame, lease_minutes: int = 600, late: str = "0 seconds") -> DataFrame:
    """A row (job_id, ROW) of a job's state after each micro-batch that touches it and each deadline that the watermark passes.

    The state store must be one that holds timers and lists (PROVIDER).
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    schema = f"job_id {dict(events.dtypes)['job_id']}, {ROW}"
    return timed.groupBy("job_id").transformWithStateInPandas(_Leases(lease_minutes), schema, "Update", "EventTime")
