"""Fingerprints of groups of vectors, with the raw bits of their floats, for groups of any size.

A vector's piece is its key, input hash, model, digest and policy, each behind its byte count, its dimension and values as
big-endian bits. The pieces of a group in the order of their keys are numbered over all tasks and hashed `size` at a time; the
hashes of a level are hashed again in the same way until one is left. A group of at most `size` vectors has the plain
SHA-256 of all its bytes, so small groups have the fingerprint of a reader that hashes one piece after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.work import stored


@F.pandas_udf(T.BinaryType())
def float_bits(values: pd.Series) -> pd.Series:
    """IEEE bits of an array of floats, big-endian, signs of zeros and payloads of NaNs kept; null for null."""
    return values.map(lambda v: None if v is None else np.asarray(v, np.float32).astype(">f4").tobytes())


def number(x: Column) -> Column:
    """Four bytes, big-endian."""
    return F.unhex(F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(1 << 32))), 8, "0"))


def text(x: Column) -> Column:
    """A string's UTF-8 bytes behind their number."""
    return F.concat(number(F.octet_length(x)), F.encode(x, "UTF-8"))


def piece(key: Column, input_hash: Column, model: Column, digest: Column, policy: Column, values: Column) -> Column:
    return F.concat(text(key), text(input_hash), text(model), text(digest), number(F.size(values)), text(policy), number(F.size(values)), float_bits(values))


def placed(rows: DataFrame, group: str, by: list[str]) -> DataFrame:
    """rows with pos, their place from 0 in their group by `by`, however large it is: sorted over all tasks by range, numbered in
    each, and moved up by the counts of the tasks before."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(tasks, group, *by).sortWithinPartitions(group, *by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for batch in batches:
            places = []
            for g, same in groupby(batch.column(group).to_pylist()):
                m = sum(1 for _ in same)
                at = at if g == last else 0
                places += range(at, at + m)
                last, at = g, at + m
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "_place"])

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    held = stored(spread.mapInArrow(run, f"{fields}, _place long").withColumn("_task", F.spark_partition_id()), "placed")
    counts = held.groupBy(group, "_task").agg(F.count("*").alias("_m"))
    moved = counts.selectExpr(group, "_task", f"coalesce(sum(_m) over (partition by `{group}` order by _task rows between unbounded preceding and 1 preceding), 0) as _moved", f"sum(_m) over (partition by `{group}`) as n")
    return held.join(moved, [group, "_task"]).withColumn("pos", F.col("_place") + F.col("_moved")).drop("_place", "_moved", "_task")


def fingerprints(vectors: DataFrame, group: str, key: str, data: str, header: Column | None = None, size: int = 4096) -> DataFrame:
    """(group, n, fingerprint) of vectors (group, key, data: the bytes of a piece); header: bytes of the group before its pieces.

    Only the number of vectors of the largest group reaches the driver. Null groups have none; keys must be unique in a group.
    """
    rows = vectors.where(F.col(group).isNotNull()).select(group, key, F.col(data).alias("_data"), (F.lit(b"") if header is None else header).alias("_head"))
    level = placed(rows, group, [key])
    most = vectors.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    while True:
        block = level.withColumn("_block", F.expr(f"pos div {size}")).groupBy(group, "n", "_head", "_block").agg(F.sort_array(F.collect_list(F.struct("pos", "_data"))).alias("_all"))
        joined = F.unhex(F.array_join(F.transform("_all", lambda x: F.hex(x["_data"])), ""))
        level = block.select(group, "n", "_head", F.col("_block").alias("pos"), F.when(F.col("n") <= size, joined).otherwise(F.unhex(F.sha2(joined, 256))).alias("_data"))
        if most <= size:
            break
        most = -(-most // size)
    return level.select(group, "n", F.sha2(F.concat("_head", number(F.col("n")), "_data"), 256).alias("fingerprint"))
