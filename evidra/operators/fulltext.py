"""Full-text search with plain tokens: AND match and cover-density rank, fusion of ranked arms.

Everything is column expressions and equi-joins on terms; a query's terms are few, a chunk's length is bounded. What is asked
for goes to the texts: up to MOST rows (counted) are broadcast, so that no word that nobody asks for is a row of a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .vector import told

RRF = 60  # fixed value of reciprocal rank fusion
MOST = 1_000_000  # asked rows that are broadcast


def document_frequencies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, df) over all rows."""
    each = docs.select(id_col, F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("df"))


def rarest_terms(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str, n: int = 3, asked_id: str | None = None) -> DataFrame:
    """(query_id, term): the n terms of each asked text, read whole, that the fewest of docs have; ties by term."""
    own = asked.select(F.col(asked_id or id_col).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))
    w = Window.partitionBy("query_id").orderBy("df", "term")
    own = told(own, 0)  # read twice, made once
    words = told(own.select("term").distinct(), MOST)
    each = docs.select(id_col, F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term")).join(words, "term", "left_semi")
    ranked = own.join(each.groupBy("term").agg(F.count("*").alias("df")), "term").withColumn("rn", F.row_number().over(w))
    return ranked.where(F.col("rn") <= n).select("query_id", "term")


def cover_density(hits: Column, terms: Column, weight: float = 0.1) -> Column:
    """The rank of sorted hits (pos, term): each shortest stretch with all terms adds weight / (1 + words in it that are no hit)."""
    last = lambda end, t: F.coalesce(F.array_max(F.transform(F.filter(hits, lambda x: (x.term == t) & (x.pos <= end)), lambda x: x.pos)), F.lit(-1))
    ends = F.transform(hits, lambda e: F.struct(F.array_min(F.transform(terms, lambda t: last(e.pos, t))).alias("p"), e.pos.alias("q")))
    covers = F.filter(ends, lambda c: (c.p >= 0) & (F.size(F.filter(ends, lambda d: (d.p == c.p) & (d.q < c.q))) == 0))
    inside = lambda c: F.size(F.filter(hits, lambda x: x.pos.between(c.p, c.q)))
    return F.aggregate(covers, F.lit(0.0), lambda s, c: s + weight / (1 + (c.q - c.p) - (inside(c) - 1)))


def matches(queries: DataFrame, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_id, id_col, density) of texts with all terms of a query (query_id, term); queries without terms match nothing."""
    asked = told(queries.select("query_id", "term").distinct(), MOST)
    need = asked.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    words = texts.select(id_col, F.posexplode(tokens(F.col(text_col))).alias("pos", "term"))
    hits = words.join(asked, "term").groupBy("query_id", id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("hits"), F.count_distinct("term").alias("n"))
    full = hits.join(need, "query_id").where(F.col("n") == F.size("terms"))
    return full.select("query_id", id_col, cover_density(F.col("hits"), F.col("terms")).alias("density"))


def matches_by_rarest(queries: DataFrame, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """As matches, for many queries of many words.

    Queries with the same terms are one. A set of terms meets the texts that hold its rarest term, and only those are
    compared: no occurrence of a frequent word is a row for each query that has it.
    """
    need = queries.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    own = texts.select(id_col, F.array_distinct(tokens(F.col(text_col))).alias("own")).repartition(id_col)  # read twice, cut into words once
    held = own.select(id_col, F.explode("own").alias("term"))
    each = need.select("terms").distinct().select("terms", F.explode("terms").alias("term"))
    df = held.select("term").join(each.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    rare = each.join(df, "term").groupBy("terms").agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.count("*").alias("n"))
    rare = rare.where(F.col("n") == F.size("terms")).select("terms", "term")  # a term that no text has ends it
    pairs = held.join(rare, "term").select(id_col, "terms").distinct()
    both = pairs.join(texts.select(id_col, F.col(text_col).alias("_text")), id_col).groupBy(id_col, "terms").agg(F.collect_list("_text").alias("_texts"))
    both = both.withColumn("ws", F.transform("_texts", tokens))  # rows that repeat an id are one text
    full = both.where(F.size(F.array_except("terms", F.flatten("ws"))) == 0)
    placed = lambda w: F.filter(F.transform(w, lambda t, k: F.struct(k.alias("pos"), t.alias("term"))), lambda x: F.array_contains("terms", x.term))
    hits = full.select("terms", id_col, F.array_sort(F.flatten(F.transform("ws", placed))).alias("hits"))
    scored = hits.select("terms", id_col, cover_density(F.col("hits"), F.col("terms")).alias("density"))
    return need.join(scored, "terms").select("query_id", id_col, "density")


def top(found: DataFrame, score: str, tie: str, k: int, name: str = "rank") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(score), tie)
    return found.withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= k)


def fuse(dense: DataFrame, other: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, cand_id, dense_rank, other_rank, rrf, pos): two ranked arms (query_id, cand_id, rank) by reciprocal ranks.

    Order: fused score, dense rank, other rank (absent ranks last), candidate.
    """
    part = lambda r: F.when(F.col(r).isNotNull(), 1 / (RRF + F.col(r))).otherwise(F.lit(0.0))
    both = dense.select("query_id", "cand_id", F.col("rank").cast("long").alias("dense_rank")).join(other.select("query_id", "cand_id", F.col("rank").alias("other_rank")), ["query_id", "cand_id"], "full")
    both = both.withColumn("rrf", part("dense_rank") + part("other_rank"))
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf"), F.col("dense_rank").asc_nulls_last(), F.col("other_rank").asc_nulls_last(), "cand_id")
    return both.withColumn("pos", F.row_number().over(w).cast("long")).where(F.col("pos") <= k)
