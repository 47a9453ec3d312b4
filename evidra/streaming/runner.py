"""Run the streams of this package over a table of events until nothing is left, and give what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.work import new_path
from . import jobs, leases


def events(spark: SparkSession, path: str) -> DataFrame:
    """(event_id, job_id, ts, kind) as a stream of the files that path names (one file, or a folder of them)."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(path.rstrip("/") + "*")
    kind = F.when(F.col("event_type") == "signup", "ENQUEUE").when(F.col("event_type") == "view", "CLAIM").when(F.col("event_type") == "click", "RENEW").when(F.col("event_type") == "purchase", "COMPLETE").otherwise("FAIL")
    return rows.select("event_id", F.col("user_id").alias("job_id"), "ts", kind.alias("kind"))


def run(rows: DataFrame, name: str, mode: str, out: str | None = None, state: str | None = None) -> str:
    """Write each micro-batch, numbered, under a folder until nothing is left; a repeated batch replaces itself. With the out and
    state of an earlier run the stream goes on where that one ended. State stays on disk: jobs hold timers and lists."""
    spark = rows.sparkSession
    out, state, setting = out or new_path(spark, name), state or new_path(spark, f"{name}-state"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number:06d}")

    spark.conf.set(setting, leases.PROVIDER)
    try:
        rows.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return out


def last_rows(spark: SparkSession, out: str) -> DataFrame:
    """The last row that a stream of jobs wrote of each."""
    rows = spark.read.parquet(out)
    w = Window.partitionBy("job_id").orderBy(F.desc("batch"))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "batch")


def windows(spark: SparkSession, path: str) -> DataFrame:
    """(start, kind, n) of the whole stream: what its last micro-batch gave of all windows."""
    out = run(jobs.windowed_counts(events(spark, path)), "windows", "complete")
    rows = spark.read.parquet(out)
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == last).select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n")


def job_states(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, status, fence, retries, rejected): the last row of each job."""
    return last_rows(spark, run(jobs.job_states(events(spark, path)), "jobs", "update"))


def leased_jobs(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, status, fence, retries, rejected, expired, dropped): the last row of each job, deadlines carried out."""
    return last_rows(spark, run(leases.leased_jobs(events(spark, path)), "leases", "update"))
