"""Evaluation datasets, pages of documents, and the sink that replaces a version's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTIONS = "questionId string, query string, expectedEvidence array<struct<fixtureEvidenceId:string,relevance:int,evidenceGroupId:string>>, noEvidence boolean, split string, category string"


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions, a JSON object a line, by a fixed schema."""
    return spark.read.schema(QUESTIONS).json(path)


def question_faults(rows: DataFrame) -> DataFrame:
    """(questionId, rule) of each broken rule; no row means that the dataset is whole."""
    e = F.col("expectedEvidence")
    rules = {
        "BLANK_QUERY": F.coalesce(F.trim("query") == "", F.lit(True)),
        "SPLIT": ~F.coalesce(F.col("split").isin("TUNING", "TEST"), F.lit(False)),
        "RELEVANCE": F.coalesce(F.exists(e, lambda x: ~x.relevance.between(0, 2)), F.lit(False)),
        "NO_EVIDENCE_HAS_SOME": F.coalesce(F.col("noEvidence") & (F.size(e) > 0), F.lit(False)),
        "EVIDENCE_MISSING": F.coalesce(~F.col("noEvidence") & (F.coalesce(F.size(e), F.lit(0)) <= 0), F.lit(False)),
    }
    each = rows.select("questionId", F.explode(F.array_compact(F.array(*[F.when(v, k) for k, v in rules.items()]))).alias("rule"))
    twice = rows.groupBy("questionId").count().where("count > 1").select("questionId", F.lit("REPEATED_ID").alias("rule"))
    return each.unionByName(twice)


def replace_versions(rows: DataFrame, folder: str, key: str = "version_id") -> int:
    """Write rows in the place of what folder holds of the same versions, and return how many it then holds of them."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(folder)
    return rows.sparkSession.read.parquet(folder).join(rows.select(key).distinct(), key, "left_semi").count()


def page_verdicts(pages: DataFrame, most_pages: int = 300, most_chars: int = 2_000_000) -> DataFrame:
    """(name, n_pages, n_chars, verdict) of documents read page by page (name, page_no, text): OK, TOO_MANY_PAGES, TOO_LONG or NO_TEXT."""
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    each = pages.groupBy("name").agg(F.count("*").alias("n_pages"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("n_chars"), F.every(blank).alias("_blank"))
    verdict = F.when(F.col("n_pages") > most_pages, "TOO_MANY_PAGES").when(F.col("n_chars") > most_chars, "TOO_LONG").when(F.col("_blank"), "NO_TEXT").otherwise("OK")
    return each.withColumn("verdict", verdict).drop("_blank")


def readable_pages(pages: DataFrame) -> DataFrame:
    """The pages with text of accepted documents; the numbers of dropped pages stay free."""
    good = page_verdicts(pages).where("verdict = 'OK'").select("name")
    return pages.where("trim(text) <> ''").join(good, "name", "left_semi")
