"""The data model over the driver's tables: versioned documents, chunks, tags, ranked runs, jobs.

Every relation is a lazy DataFrame; `register` also makes them views for Spark SQL. DUCK holds the same
derivations as common table expressions, written for the other engine, so that an oracle never runs our plans.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chunks
from ..operators.vector import knn_in_blocks

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def versions(docs: DataFrame) -> DataFrame:
    """Two versions a document; a failed one never becomes active, the newest of the others is."""
    v = docs.select(F.expr("doc_id div 2").alias("document_id"), F.col("doc_id").alias("version_id"), (F.col("doc_id") % 2 + 1).alias("version_no"), (F.expr("doc_id div 2") % 8 + 1).alias("owner_id"), "lang", "source", "text", (F.col("doc_id") % 7 == 0).alias("failed"))
    active = v.where("not failed").groupBy("document_id").agg(F.max_by("version_id", "version_no").alias("active_version_id"))
    status = F.when(F.col("failed"), "FAILED").when(F.col("version_id") == F.col("active_version_id"), "ACTIVE").otherwise("SUPERSEDED")
    return v.join(active, "document_id", "left").withColumn("status", status)


def active_chunks(docs: DataFrame) -> DataFrame:
    """The chunks of active versions: what search may see."""
    v = versions(docs).where("status = 'ACTIVE'")
    return chunks(v.select("document_id", "version_id", "owner_id", "lang", "source", "text"), "text").withColumn("chunk_id", F.col("version_id") * 1_000_000 + F.col("chunk_no"))


def every_50th(vectors: DataFrame) -> DataFrame:
    """The query set of the whole job: it grows with the table."""
    return vectors.where("vec_id % 50 = 0")


def runs(vectors: DataFrame, k: int = 20) -> DataFrame:
    """Ranked candidates of every 50th vector: relevance 2 for the same label, 1 for a neighbouring one.

    The split and the category go by the number of the query, as all ids are even.
    """
    q = every_50th(vectors)
    lab = vectors.select("vec_id", "label")
    found = knn_in_blocks(vectors, q, k).join(lab.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label")), "query_id").join(lab.withColumnRenamed("vec_id", "cand_id"), "cand_id")
    rel = F.when(F.col("label") == F.col("q_label"), 2).when(F.abs(F.col("label") - F.col("q_label")) == 1, 1).otherwise(0)
    number = F.expr("query_id div 50")
    split = F.when(number % 2 == 0, "TUNING").otherwise("TEST")
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "cand_id", "score", rel.cast("long").alias("rel"), (F.col("cand_id") % 50).alias("group_id"), split.alias("split"), F.concat(F.lit("C"), number % 3).alias("category"))


def active_runs(vectors: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, cand_id, score, rank): every 50th vector against those of active versions, which alone are ranked."""
    active = versions(docs).where("status = 'ACTIVE'").select(F.col("version_id").alias("vec_id"))
    return knn_in_blocks(vectors.join(active, "vec_id", "left_semi"), every_50th(vectors), k)


_TAGS = """SELECT n_nationkey AS tag_id, CAST(NULL AS BIGINT) AS owner_id, n_name AS name FROM nation
    UNION ALL SELECT 1000 + s_suppkey, s_suppkey % 8 + 1, s_name FROM supplier"""
_DOCUMENT_TAGS = """SELECT document_id, owner_id, document_id % 25 AS tag_id FROM versions_v
    UNION ALL SELECT document_id, owner_id, 1000 + document_id % 40 FROM versions_v WHERE version_no = 1"""
_JOB_EVENTS = """SELECT event_id, user_id AS job_id, ts, CASE event_type WHEN 'signup' THEN 'ENQUEUE' WHEN 'view' THEN 'CLAIM'
    WHEN 'click' THEN 'RENEW' WHEN 'purchase' THEN 'COMPLETE' ELSE 'FAIL' END AS kind, value FROM events"""


def register(spark: SparkSession, sf_dir: str, body: str) -> None:
    """Make views of the relations that a statement names, and of those that these read."""
    names = set(re.findall(r"\w+", body))
    docs = lambda: table(spark, sf_dir, "documents")
    made: dict[str, Callable[[], DataFrame]] = {
        "versions_v": lambda: versions(docs()),
        "chunks_v": lambda: active_chunks(docs()),
        "runs_v": lambda: runs(table(spark, sf_dir, "embeddings")),
        "tags_v": lambda: spark.sql(_TAGS),
        "document_tags_v": lambda: spark.sql(_DOCUMENT_TAGS),
        "job_events_v": lambda: spark.sql(_JOB_EVENTS),
    }
    reads = {"tags_v": _TAGS, "document_tags_v": _DOCUMENT_TAGS, "job_events_v": _JOB_EVENTS}
    for name in names & reads.keys():
        names |= set(re.findall(r"\w+", reads[name]))
    for name in names & set(TABLES):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    for name, relation in made.items():
        if name in names:
            relation().createOrReplaceTempView(name)


DUCK = r"""WITH RECURSIVE versions_0 AS (SELECT doc_id // 2 AS document_id, doc_id AS version_id, doc_id % 2 + 1 AS version_no, (doc_id // 2) % 8 + 1 AS owner_id, lang, source, text, doc_id % 7 = 0 AS failed FROM documents),
versions_v AS (SELECT v.*, a.active_version_id, CASE WHEN failed THEN 'FAILED' WHEN version_id = active_version_id THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS status
  FROM versions_0 v LEFT JOIN (SELECT document_id, arg_max(version_id, version_no) AS active_version_id FROM versions_0 WHERE NOT failed GROUP BY 1) a USING (document_id)),
chunks_0 AS (SELECT document_id, version_id, owner_id, lang, source, text, unnest(range(0, (greatest(0, ceil((length(text) - 800) / 680.0))::BIGINT + 1))) AS i FROM versions_v WHERE status = 'ACTIVE'),
chunks_1 AS (SELECT *, i + 1 AS chunk_no, regexp_replace(substr(text, i * 680 + 1, 800), '^\s+|\s+$', '', 'g') AS content FROM chunks_0),
chunks_v AS (SELECT document_id, version_id, owner_id, lang, source, chunk_no, content, version_id * 1000000 + chunk_no AS chunk_id FROM chunks_1 WHERE content <> ''),
unit AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
runs_0 AS (SELECT q.vec_id AS query_id, c.vec_id AS cand_id, list_cosine_similarity(q.v, c.v) AS score, q.label AS ql, c.label AS cl FROM unit q, unit c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
runs_1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_id) AS rank FROM runs_0),
runs_v AS (SELECT query_id, rank, cand_id, score, CASE WHEN ql = cl THEN 2 WHEN abs(ql - cl) = 1 THEN 1 ELSE 0 END AS rel, cand_id % 50 AS group_id,
  CASE WHEN (query_id // 50) % 2 = 0 THEN 'TUNING' ELSE 'TEST' END AS split, concat('C', (query_id // 50) % 3) AS category FROM runs_1 WHERE rank <= 20),
tags_v AS (SELECT n_nationkey AS tag_id, NULL::BIGINT AS owner_id, n_name AS name FROM nation UNION ALL SELECT 1000 + s_suppkey, s_suppkey % 8 + 1, s_name FROM supplier),
document_tags_v AS (SELECT document_id, owner_id, document_id % 25 AS tag_id FROM versions_v UNION ALL SELECT document_id, owner_id, 1000 + document_id % 40 FROM versions_v WHERE version_no = 1),
job_events_v AS (SELECT event_id, user_id AS job_id, ts, CASE event_type WHEN 'signup' THEN 'ENQUEUE' WHEN 'view' THEN 'CLAIM' WHEN 'click' THEN 'RENEW' WHEN 'purchase' THEN 'COMPLETE' ELSE 'FAIL' END AS kind, value FROM events)
"""
