"""Checks of what a judge says about candidates: its sentence must stand in the snippet that it was given, and in a chunk that
was submitted to it and is the owner's and active now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verified(judgements: DataFrame, submitted: DataFrame, chunks: DataFrame) -> DataFrame:
    """judgements (query_id, owner_id, chunk_id, found, sentence, snippet) with status, the first that holds of MODEL_NONE,
    CHUNK_NOT_SUBMITTED, SENTENCE_NOT_IN_SNIPPET, CHUNK_NOT_ACTIVE_OWNER, SENTENCE_NOT_IN_SOURCE, else ACCEPTED.

    submitted (query_id, chunk_id) are the chunks that the judge saw, chunks (chunk_id, owner_id, content) the active ones. A
    judgement without a snippet is held against the source alone; repeated submissions are one.
    """
    given = submitted.select("query_id", "chunk_id").distinct().withColumn("_given", F.lit(True))
    source = chunks.select("chunk_id", F.col("owner_id").alias("_owner"), F.col("content").alias("_content"))
    rows = judgements.join(given, ["query_id", "chunk_id"], "left").join(source, "chunk_id", "left")
    status = (
        F.when(~F.coalesce("found", F.lit(False)), "MODEL_NONE")
        .when(F.col("_given").isNull(), "CHUNK_NOT_SUBMITTED")
        .when(F.col("snippet").isNotNull() & ~F.contains("snippet", "sentence"), "SENTENCE_NOT_IN_SNIPPET")
        .when(F.col("_owner").isNull() | (F.col("_owner") != F.col("owner_id")), "CHUNK_NOT_ACTIVE_OWNER")
        .when(~F.contains("_content", "sentence"), "SENTENCE_NOT_IN_SOURCE")
        .otherwise("ACCEPTED")
    )
    return rows.withColumn("status", status).drop("_given", "_owner", "_content")
