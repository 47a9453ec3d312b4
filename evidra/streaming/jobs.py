"""The job machine and plain windows over a stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import step

_COLUMNS = ["status", "fence", "retries", "rejected", "lease_until", "next_retry"]


def job_states(events: DataFrame, lease_minutes: int = 600) -> DataFrame:
    """A row with a job's state after each micro-batch that touches it; the last row per job is the batch fold's."""

    def run(key: tuple, logs: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        log = pd.concat(list(logs)).sort_values(["ts", "event_id"])
        state = (None, 0, 0, 0, None, None)
        if held.exists:
            status, fence, retries, rejected, until, due = held.get
            state = (status or None, fence, retries, rejected, *(pd.Timestamp(x, unit="us") if x >= 0 else None for x in (until, due)))
        for kind, ts in log[["kind", "ts"]].itertuples(index=False):
            state = step(state, kind, None if pd.isna(ts) else ts.tz_localize(None) if ts.tzinfo else ts, pd.Timedelta(minutes=lease_minutes))
        number = lambda x: -1 if x is None else x.value // 1000
        held.update((state[0] or "", *state[1:4], number(state[4]), number(state[5])))
        yield pd.DataFrame([(key[0], *state[:4])], columns=["job_id", *_COLUMNS[:4]])

    schema = f"job_id {dict(events.dtypes)['job_id']}, status string, fence long, retries long, rejected long"
    return events.groupBy("job_id").applyInPandasWithState(run, schema, "status string, fence long, retries long, rejected long, lease long, due long", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n) per tumbling window of event time; later events than the watermark are dropped by design."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")
