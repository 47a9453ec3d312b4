"""Connected components by alternating large-star and small-star steps, all as DataFrame joins.

Every step writes its edges to the shared folder; nothing but two numbers reaches the driver.
A star around a hot node costs its edges only: the minimum is a partial aggregate, and the join back is
one that Spark may split when it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node reachable; nodes without edges are absent. Nodes are of any ordered type.

    Nulls and loops are ignored; repeated edges and either direction are fine; empty in, empty out.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e, mark = stored(e, "edges"), None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        old, e = e, stored(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        discard(old)
        seen = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if seen == mark:
            break
        mark = seen
    root = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return root.unionByName(root.select(F.col("root").alias("node"), "root").distinct())
