"""Operators on small relations, and the plans that matter."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from evidra.functions import text as tx
from evidra.operators import jobs, typed, vector
from evidra.streaming import jobs as stream


def test_chunks_cover_and_overlap(spark):
    text = "".join(chr(97 + i % 26) for i in range(1700))
    got = tx.chunks(spark.createDataFrame([(1, text), (2, "  \n "), (3, None), (4, "x" * 800)], "id long, text string"), "text").orderBy("id", "chunk_no").collect()
    assert [(r.id, r.chunk_no, r.content) for r in got] == [(1, 1, text[:800]), (1, 2, text[680:1480]), (1, 3, text[1360:]), (4, 1, "x" * 800)]


def test_numbers(spark):
    r = spark.createDataFrame([("up 1,200.50 and 007 and v2.1 x9. 1200.5",)], "t string").select(tx.number_tokens(F.col("t")).alias("n")).first()
    assert r.n == ["1200.5", "7", "2.1", "9"]


def test_three_valued_logic(spark):
    s, c, u = "SATISFIED", "CONTRADICTED", "UNKNOWN"
    rows = spark.createDataFrame([(s, u), (c, u), (s, c), (s, s), (u, u)], "a string, b string").select(typed.all_of(F.col("a"), F.col("b")).alias("all"), typed.any_of(F.col("a"), F.col("b")).alias("any")).collect()
    assert [r["all"] for r in rows] == [u, c, c, s, u]
    assert [r["any"] for r in rows] == [s, c, s, s, u]
    unknown = spark.range(1).select(typed.compare_numbers(F.lit(None).cast("double"), "GT", F.lit(1.0)).alias("x")).first().x
    assert unknown == u


def test_vector_faults(spark):
    rows = spark.createDataFrame([([],), ([1.0],), ([float("nan"), 1.0],), ([0.0, 0.0],), ([1.0, 2.0],), (None,)], "v array<float>")
    assert [r.x for r in rows.select(vector.verdict(F.col("v"), 2).alias("x")).collect()] == ["EMPTY", "DIMENSION", "NOT_FINITE", "ZERO", "OK", "EMPTY"]


def test_knn_refuses_too_many_queries(spark):
    v = spark.range(5).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    with pytest.raises(ValueError):
        vector.knn(v, v, 2, most=3)


def test_single_query_plan_is_a_top_k(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    plan = v.select("vec_id", vector.cosine_distance(F.col("embedding"), F.array(*[F.lit(1.0)] * 64)).alias("d")).orderBy("d", "vec_id").limit(5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


LOG = [("ENQUEUE", 0), ("CLAIM", 1), ("FAIL", 2), ("CLAIM", 2.5), ("CLAIM", 4), ("RENEW", 5), ("COMPLETE", 6), ("COMPLETE", 7)]


def _log(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(j, i, day + dt.timedelta(minutes=m), k) for j in (1, 2) for i, (k, m) in enumerate(LOG[: 8 if j == 1 else 3])]
    return spark.createDataFrame(rows, "job_id long, event_id long, ts timestamp_ntz, kind string")


def test_job_fold(spark):
    got = {r.job_id: (r.status, r.fence, r.retries, r.rejected) for r in jobs.fold(_log(spark)).collect()}
    assert got == {1: ("COMPLETED", 2, 1, 2), 2: ("RETRY_WAIT", 1, 1, 0)}  # a claim before its time and a stale completion are rejected


def test_stream_equals_fold(spark, tmp_path):
    log = _log(spark).withColumn("ts", F.col("ts").cast("timestamp"))
    for part in (0, 1):  # two micro-batches
        log.where(F.col("event_id") % 8 < 4 if part == 0 else F.col("event_id") % 8 >= 4).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    last = {}

    def keep(df, _):
        last.update({r.job_id: (r.status, r.fence, r.retries, r.rejected) for r in df.collect()})

    q = stream.job_states(source).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert last == {r.job_id: (r.status, r.fence, r.retries, r.rejected) for r in jobs.fold(_log(spark)).collect()}
