"""Frozen tables, publications, fingerprints, and leases that end without an event."""

import datetime as dt
import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from evidra.operators import fingerprints as fp
from evidra.plans import artefacts
from evidra.plans.queries import QUERIES
from evidra.sources import store
from evidra.streaming import leases, runner


def test_digest_knows_rows_not_their_order(spark):
    rows = [(1, "a", 0.5, None), (2, "b", -0.0, [1.0, None]), (2, "b", -0.0, [1.0, None]), (None, "", None, [])]
    schema = "k long, t string, x double, v array<double>"
    one = store.digest_of(spark.createDataFrame(rows, schema).repartition(3)).first()
    assert one == store.digest_of(spark.createDataFrame(rows[::-1], schema).select("v", "x", "t", "k")).first() and one["rows"] == 4
    others = [rows[:3], [*rows, rows[1]], [(1, "a", 0.5, []), *rows[1:]], [(1, "ab", 0.5, None), *rows[1:]], [(1, "a", 0.50001, None), *rows[1:]]]
    assert len({store.digest_of(spark.createDataFrame(r, schema)).first()["digest"] for r in others} | {one["digest"]}) == 6
    assert store.digest_of(spark.createDataFrame([], schema)).first()["rows"] == 0


def test_freeze_and_replay(spark, tmp_path):
    root, df = f"file://{tmp_path}", spark.range(100).withColumn("t", F.col("id").cast("string"))
    digest = store.freeze(df, root)
    assert store.freeze(df.orderBy(F.desc("id")).repartition(7), root) == digest
    assert store.replay(spark, root, digest).count() == 100
    with pytest.raises(store.Refused):
        store.replay(spark, root, "0" * 64)
    df.where("id < 99").unionByName(df.where("id = 99").withColumn("t", F.lit("x"))).write.mode("overwrite").parquet(f"{root}/{digest}")
    with pytest.raises(store.Refused):  # a changed row
        store.replay(spark, root, digest)


def test_coverage(spark):
    have = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (3, 1)], "q int, r int")
    want = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "q int, r int")
    assert {tuple(r) for r in store.coverage(have, want, ["q", "r"]).collect()} == {(1, 2, "REPEATED"), (2, 1, "MISSING"), (3, 1, "UNEXPECTED")}


def test_publications_are_whole_or_not_there(spark, tmp_path):
    root = f"file://{tmp_path}"
    a = {"x": spark.range(5), "y": spark.range(3).withColumnRenamed("id", "k")}
    with pytest.raises(store.Refused):
        store.snapshot(spark, root)
    first = store.publish(spark, root, a)
    old = store.snapshot(spark, root)
    assert first.number == old.number == 1
    assert store.publish(spark, root, a).number == 1  # the same rows again: nothing new
    with pytest.raises(store.Refused):  # a rule
        store.publish(spark, root, {"x": spark.range(9), "y": spark.range(0).withColumnRenamed("id", "k")}, lambda t: {"EMPTY": t["x"].crossJoin(t["y"].agg(F.count("*").alias("n"))).where("n = 0")})

    boom = F.udf(lambda k: 1 // (k - 3), "long")
    with pytest.raises(Exception, match="ZeroDivision"):  # a writer that dies in its second table
        store.publish(spark, root, {"x": spark.range(9), "y": spark.range(9).select(boom("id").alias("k"))})
    assert store.snapshot(spark, root).number == 1 and store.snapshot(spark, root).tables["x"].count() == 5
    second = store.publish(spark, root, {"x": spark.range(7), "y": a["y"]}, after=1)
    with pytest.raises(store.Refused):  # a writer that read generation 1
        store.publish(spark, root, {"x": spark.range(8), "y": a["y"]}, after=1)
    assert second.number == 2 and store.snapshot(spark, root, verify=True).tables["x"].count() == 7
    assert old.tables["x"].count() == 5 and store.snapshot(spark, root, 1).tables["x"].count() == 5  # readers stay where they were
    store.snapshot(spark, root).tables["x"].limit(6).write.parquet(f"{root}/other")
    spark.read.parquet(f"{root}/other").write.mode("overwrite").parquet(f"{root}/generations/{second.generation}/x")
    with pytest.raises(store.Refused):
        store.snapshot(spark, root, verify=True)


def plain(rows, head: bytes) -> str:
    h = hashlib.sha256(head + struct.pack(">i", len(rows)))
    for key, vector in sorted(rows):
        for t in (key, "in" + key, "model", "digest"):
            h.update(struct.pack(">i", len(t.encode())) + t.encode())
        h.update(struct.pack(">i", len(vector)) + struct.pack(">i", 3) + "pol".encode() + struct.pack(">i", len(vector)))
        h.update(b"".join(struct.pack(">f", x) for x in vector))
    return h.hexdigest()


@pytest.mark.parametrize("size", [4096, 50])
def test_fingerprint_of_small_groups_is_plain(spark, size):
    rng = random.Random(3)
    rows = {g: [(f"k{k:03d}é", [rng.choice([0.0, -0.0, 1.5, float("inf"), rng.random()]) for _ in range(4)]) for k in range(n)] for g, n in ((1, 1), (2, 49), (3, 50))}
    df = spark.createDataFrame([(g, k, v) for g, vs in rows.items() for k, v in vs] + [(None, "x", [1.0])], "g int, k string, v array<float>").repartition(5)
    piece = fp.piece(F.col("k"), F.concat(F.lit("in"), "k"), F.lit("model"), F.lit("digest"), F.lit("pol"), F.col("v"))
    got = {r.g: (r.n, r.fingerprint) for r in fp.fingerprints(df.withColumn("p", piece), "g", "k", "p", fp.text(F.lit("head")), size).collect()}
    assert got == {g: (len(vs), plain(vs, struct.pack(">i", 4) + b"head")) for g, vs in rows.items()}


def test_fingerprint_of_large_groups_is_a_tree(spark):
    """A level's hashes are hashed again until one is left; any changed bit, order kept, changes the fingerprint."""
    n, size = 1000, 7
    df = spark.range(n).select(F.lit(1).alias("g"), F.format_string("%05d", "id").alias("k"), F.encode(F.col("id").cast("string"), "UTF-8").alias("p")).repartition(6)
    level = [str(k).encode() for k in range(n)]
    while True:
        level = [hashlib.sha256(b"".join(level[k : k + size])).digest() for k in range(0, len(level), size)]
        if len(level) == 1:
            break
    assert fp.fingerprints(df, "g", "k", "p", size=size).first()["fingerprint"] == hashlib.sha256(struct.pack(">i", n) + level[0]).hexdigest()
    other = df.withColumn("p", F.when(F.col("k") == "00500", F.lit(b"x")).otherwise(F.col("p")))
    assert fp.fingerprints(other, "g", "k", "p", size=size).first()["fingerprint"] != fp.fingerprints(df, "g", "k", "p", size=size).first()["fingerprint"]


EVENTS = "job_id long, event_id long, ts timestamp, kind string"


def at(minute: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_leases_end_without_an_event(spark, tmp_path):
    """A silent worker is recovered by a timer, its pieces dropped; after the retry's due time the job is ready again."""
    logs = [[(1, 1, at(0), "ENQUEUE"), (1, 2, at(1), "CLAIM"), (1, 3, at(2), "RENEW"), (2, 4, at(3), "ENQUEUE")], [(2, 5, at(12.5), "CLAIM")], [(2, 6, at(13.2), "COMPLETE")]]
    for k, rows in enumerate(logs):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"file://{tmp_path}/in/part={k}")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    out = runner.run(leases.leased_jobs(stream, 10), "leases", "update")
    told = [tuple(r) for r in spark.read.parquet(out).orderBy("batch", "job_id").select("job_id", "status", "fence", "retries", "expired", "dropped").collect()]
    assert told[:3] == [(1, "RUNNING", 1, 0, 0, 0), (2, "READY", 0, 0, 0, 0), (2, "RUNNING", 1, 0, 0, 0)]
    assert (1, "RETRY_WAIT", 2, 1, 1, 1) in told and told[-1] == (1, "READY", 2, 1, 1, 1)


def test_leases_go_on_after_a_restart(spark, tmp_path):
    """Cut into files and restarted in mid-stream, the states are those of the batch fold."""
    rng = random.Random(6)
    rows = sorted(((rng.randrange(12), k, at(rng.randrange(3000) + rng.random()), rng.choice(["ENQUEUE", "CLAIM", "CLAIM", "RENEW", "RENEW", "COMPLETE", "FAIL"])) for k in range(900)), key=lambda r: r[2])
    parts = [rows[k : k + 180] for k in range(0, 900, 180)]
    out = state = None
    for run_no, some in enumerate((parts[:2], parts[2:])):
        for k, part in enumerate(some):
            spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(f"file://{tmp_path}/in/part={run_no}{k}")
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
        state = f"file://{tmp_path}/state"
        out = runner.run(leases.leased_jobs(stream, 60), "leases", "update", f"file://{tmp_path}/out", state)
    now = rows[-1][2].replace(microsecond=rows[-1][2].microsecond // 1000 * 1000)
    want = {tuple(r) for r in leases.recovered(spark.createDataFrame(rows, EVENTS), now, 60).collect()}
    names = ["job_id", "status", "fence", "retries", "rejected", "expired", "dropped"]
    assert {tuple(r) for r in runner.last_rows(spark, out).select(names).collect()} == want and sum(r[5] for r in want) > 20


def test_children_of_an_inventory_are_made_once(spark, monkeypatch):
    seen, publish = {}, artefacts.store.publish
    monkeypatch.setattr(artefacts.store, "publish", lambda spark, root, tables, *more: seen.update(tables) or publish(spark, root, tables, *more))
    QUERIES["published_inventory"](spark, "/root/testdata/sf0.001")
    assert set(seen) == {"children", "passages", "manifests"}
    assert not any("Generate" in t._jdf.queryExecution().optimizedPlan().toString() for t in seen.values())
