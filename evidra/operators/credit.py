"""nDCG in which a rank is credited for one group of evidence at most, and a group once.

Each rank takes the best of the units that it covers whose group no rank before has taken (the first of equal ones); the
ideal takes the best unit of each group. A fold over at most k ranks of a query; ranks beyond are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _gain(ranks: Column) -> Column:
    """The discounted gain of ranks, an array of (rank, units: array of (gain, turn, grp))."""
    begin = F.struct(F.array().cast("array<bigint>").alias("taken"), F.lit(0.0).alias("sum"))

    def step(acc: Column, r: Column) -> Column:
        best = F.array_max(F.filter(r["units"], lambda u: ~F.array_contains(acc["taken"], u["grp"])))
        return F.struct(
            F.when(best.isNull(), acc["taken"]).otherwise(F.array_append(acc["taken"], best["grp"])).alias("taken"),
            (acc["sum"] + F.coalesce(best["gain"] / F.log2(r["rank"] + F.lit(1.0)), F.lit(0.0))).alias("sum"),
        )

    return F.aggregate(ranks, begin, step)["sum"]


def credited_ndcg(covered: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, ndcg) of covered (query_id, rank, turn, grp, gain), the units of each rank in the order of their turn, and gold
    (query_id, grp, gain), all units of a query. Queries whose gold has no gain have no value and no row; those without covered units have 0."""
    units = F.collect_list(F.struct(F.col("gain").cast("double").alias("gain"), (-F.col("turn")).alias("turn"), F.col("grp").cast("bigint").alias("grp")))
    ranks = covered.where(F.col("rank") <= k).groupBy("query_id", "rank").agg(units.alias("units"))
    found = ranks.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "units"))).alias("ranks"))
    best = gold.groupBy("query_id", "grp").agg(F.max("gain").alias("gain"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain")))
    ideal = best.withColumn("place", place).where(F.col("place") <= k).groupBy("query_id").agg(F.sum(F.col("gain") / F.log2(F.col("place") + F.lit(1.0))).alias("ideal")).where("ideal > 0")
    return ideal.join(found, "query_id", "left").select("query_id", (F.coalesce(_gain(F.col("ranks")), F.lit(0.0)) / F.col("ideal")).alias("ndcg"))
