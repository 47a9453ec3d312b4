"""Leased jobs: one machine for indexing, outbox and clean-up queues, as a fold over an event log.

A job is READY after ENQUEUE, RUNNING after CLAIM (the fence grows, a lease starts), back in RETRY_WAIT after
FAIL up to three times (1, 5, 15 minutes), then FAILED; COMPLETE ends it. Events that do not fit the state
(a stale completion, a renewal without a claim, one without a time) change nothing and are counted as rejected.
Events of a job are in the order of (time, id).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RETRY_MINUTES = (1, 5, 15)
STATE = "status string, fence long, retries long, rejected long, lease_until timestamp_ntz, next_retry timestamp_ntz"


def retry_at(ts: Column, retries: Column) -> Column:
    """When the next try is due after so many earlier ones; null when none is left."""
    return F.when(retries == 0, ts + F.expr("INTERVAL '1' MINUTE")).when(retries == 1, ts + F.expr("INTERVAL '5' MINUTE")).when(retries == 2, ts + F.expr("INTERVAL '15' MINUTE"))


def step(state: tuple, kind: str, ts: dt.datetime | None, lease: dt.timedelta) -> tuple:
    """The next (status, fence, retries, rejected, lease_until, next_retry)."""
    status, fence, retries, rejected, until, due = state
    if ts is None:
        return status, fence, retries, rejected + 1, until, due
    if kind == "ENQUEUE" and status in (None, "COMPLETED", "FAILED"):
        return "READY", fence, 0, rejected, None, None
    if kind == "CLAIM" and (status == "READY" or status == "RETRY_WAIT" and due <= ts or status == "RUNNING" and until < ts):
        return "RUNNING", fence + 1, retries, rejected, ts + lease, None
    if status == "RUNNING" and until >= ts:
        if kind == "RENEW":
            return status, fence, retries, rejected, ts + lease, None
        if kind == "COMPLETE":
            return "COMPLETED", fence, retries, rejected, None, None
        if kind == "FAIL":
            if retries < len(RETRY_MINUTES):
                return "RETRY_WAIT", fence, retries + 1, rejected, None, ts + dt.timedelta(minutes=RETRY_MINUTES[retries])
            return "FAILED", fence, retries, rejected, None, None
    return status, fence, retries, rejected + 1, until, due


def fold(events: DataFrame, lease_minutes: int = 600) -> DataFrame:
    """(job_id, state columns) after all events (job_id, event_id, ts, kind).

    Logs come sorted, one after the other, so that a task holds one state and one Arrow batch, however long a log is.
    """
    kind = dict(events.dtypes)["job_id"]
    stamp = pa.timestamp("us")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lease, begin, now, state = dt.timedelta(minutes=lease_minutes), (None, 0, 0, 0, None, None), [], None
        for batch in batches:
            done: list[tuple] = []
            for job, what, ts in zip(batch.column("job_id").to_pylist(), batch.column("kind").to_pylist(), batch.column("ts").to_pylist(), strict=True):
                if now != [job]:
                    done += [(now[0], *state)] if now else []
                    now, state = [job], begin
                state = step(state, what, ts, lease)
            job_type = batch.column("job_id").type
            yield table(done, job_type)
        if now:
            yield table([(now[0], *state)], job_type)

    def table(rows: list[tuple], job_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (job_type, pa.string(), pa.int64(), pa.int64(), pa.int64(), stamp, stamp)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["job_id", "status", "fence", "retries", "rejected", "lease_until", "next_retry"])

    rows = events.select("job_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "kind")
    return rows.repartition("job_id").sortWithinPartitions("job_id", "ts", "event_id").mapInArrow(run, f"job_id {kind}, {STATE}")


def ranked_by_time(rows: DataFrame, ts: str, tie: str, name: str, unit: str = "hour") -> DataFrame:
    """Number all rows from 1 by (ts, tie): inside each unit of time, plus all that came in earlier ones.

    Only one row per unit is ordered in one place, so no task holds all rows. A null time comes first.
    """
    rows = rows.withColumn("_unit", F.date_trunc(unit, F.col(ts)))
    before = Window.orderBy(F.col("_unit").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_unit").agg(F.count("*").alias("_n")).select(F.col("_unit").alias("_u"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_unit").orderBy(ts, tie))
    return rows.withColumn("_in", inside).join(offsets, F.col("_unit").eqNullSafe(F.col("_u"))).withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_unit", "_u", "_before", "_in")


def expired(state: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose lease is over, with the fence that shuts out their old worker and what follows."""
    after = F.when(F.col("retries") < len(RETRY_MINUTES), "RETRY_WAIT").otherwise("FAILED")
    return state.where((F.col("status") == "RUNNING") & (F.col("lease_until") < now)).withColumn("fence", F.col("fence") + 1).withColumn("status", after)
