"""Named queries of frozen runs, published inventories and fingerprints.

Each writes what it reads back to a new folder of the shared work folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fingerprints as fp
from ..sources import store
from ..sources.work import new_path, stored
from .corpus import every_50th, register, table
from .queries import pair
from .retrieval import _PASSAGES, _children

_RUN_D = ", f AS (SELECT query_id, rank, cand_id, (round(score * 1000000))::BIGINT AS micros FROM runs_v)"
_ROW_D = "octet_length(encode(cand_id::VARCHAR)) || ':' || cand_id || octet_length(encode(micros::VARCHAR)) || ':' || micros || octet_length(encode(query_id::VARCHAR)) || ':' || query_id || octet_length(encode(rank::VARCHAR)) || ':' || rank"
_PARTS_D = " || '|' || ".join(f"(sum(('0x' || substr(h, {8 * k + 1}, 8))::BIGINT) % 4294967296)::BIGINT" for k in range(8))


def _frozen(spark, sf_dir) -> tuple[str, str, DataFrame]:
    register(spark, sf_dir, "runs_v")
    run = spark.table("runs_v").select("query_id", "rank", "cand_id", F.round(F.col("score") * 1_000_000).cast("long").alias("micros"))
    root = new_path(spark, "frozen")
    return root, store.freeze(run, root), run


@pair(_RUN_D + f", d AS (SELECT sha256({_ROW_D}) AS h FROM f) SELECT sha256(count(*) || '|' || {_PARTS_D}) AS digest, count(*) AS n_rows, (SELECT count(DISTINCT query_id) FROM f) AS n_queries, 0::BIGINT AS n_faults FROM d")
def candidate_freeze(spark, sf_dir):
    """The ranked run of every 50th vector, frozen: its digest, its rows and the queries that it does not cover."""
    root, digest, _ = _frozen(spark, sf_dir)
    run = store.replay(spark, root, digest)
    wanted = every_50th(table(spark, sf_dir, "embeddings")).select(F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(20).cast("long"))).alias("rank"))
    faults = store.coverage(run, wanted, ["query_id", "rank"]).agg(F.count("*").alias("n_faults"))
    return run.agg(F.count("*").alias("n_rows"), F.count_distinct("query_id").alias("n_queries")).crossJoin(faults).select(F.lit(digest).alias("digest"), "n_rows", "n_queries", "n_faults")


@pair(_RUN_D + " SELECT query_id, count(*) AS n, min(micros) AS low, max(micros) AS high, arg_min(cand_id, rank) AS first FROM f GROUP BY query_id")
def candidate_replay(spark, sf_dir):
    """The frozen run read back, its digest checked, and what an evaluation makes of it."""
    root, digest, _ = _frozen(spark, sf_dir)
    return store.replay(spark, root, digest).groupBy("query_id").agg(F.count("*").alias("n"), F.min("micros").alias("low"), F.max("micros").alias("high"), F.min_by("cand_id", "rank").alias("first"))


def inventory_checks(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows that forbid an inventory: repeated keys, children of no passage, passages without children, counts that differ."""
    kids, parts = t["children"], t["passages"]
    counted = kids.groupBy("version_id", "parent").agg(F.count("*").alias("n"))
    return {
        "REPEATED_PASSAGE": parts.groupBy("version_id", "parent").count().where("count > 1"),
        "REPEATED_CHILD": kids.groupBy("version_id", "ordinal").count().where("count > 1"),
        "ORPHAN": kids.join(parts, ["version_id", "parent"], "left_anti"),
        "COUNT": parts.join(counted, ["version_id", "parent"], "left").where("n is null or n <> n_children"),
        "MANIFEST": t["manifests"].join(parts.groupBy("version_id").agg(F.count("*").alias("n")), "version_id", "full").where("n is null or n_passages is null or n <> n_passages"),
    }


@pair(_PASSAGES + """, p AS (SELECT version_id, parent, count(*) AS n_children, min(ordinal) AS first FROM kids GROUP BY ALL), m AS (SELECT version_id, count(*) AS n_passages FROM p GROUP BY 1)
SELECT 1::BIGINT AS generation, version_id, parent::BIGINT AS parent, n_children, first::BIGINT AS first, n_passages FROM p JOIN m USING (version_id)""")
def published_inventory(spark, sf_dir):
    """Passages, children and manifests of all versions, published as one generation and read from its snapshot."""
    kids = stored(_children(spark, sf_dir).select("version_id", "parent", "ordinal"), "kids")  # read for each table, made once
    parts = kids.groupBy("version_id", "parent").agg(F.count("*").alias("n_children"), F.min("ordinal").alias("first"))
    root = new_path(spark, "inventory")
    store.publish(spark, root, {"children": kids, "passages": parts, "manifests": parts.groupBy("version_id").agg(F.count("*").alias("n_passages"))}, inventory_checks)
    now = store.snapshot(spark, root, verify=True)
    return now.tables["passages"].join(now.tables["manifests"], "version_id").withColumn("generation", F.lit(now.number).cast("long"))


@pair(None)
def vector_fingerprints(spark, sf_dir):
    """One fingerprint of all vectors of each label, in the order of their keys, by the bits of their floats."""
    v = table(spark, sf_dir, "embeddings").select("label", F.format_string("V%012d", "vec_id").alias("key"), F.col("embedding").cast("array<float>").alias("v"))
    v = v.withColumn("piece", fp.piece(F.col("key"), F.sha2("key", 256), F.lit("embedding-v1"), F.sha2(F.lit("embedding-v1"), 256), F.lit("policy-v1"), F.col("v")))
    return fp.fingerprints(v, "label", "key", "piece", fp.text(F.lit("verified-fingerprint-v1")))
