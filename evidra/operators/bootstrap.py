"""Cluster bootstrap of paired differences at scale: seeded Poisson weights added into arrays of a fixed length.

Resampling n clusters n times gives each a Poisson(1) number of copies for large n. A cluster's number of copies in a sample follows
from its number, the sample and a seed by integer arithmetic alone, so no draw is a row and no cluster must be known to
another: a task adds each of its clusters to all samples at once and gives one array of sums, and arrays are added.
Differences are integers in millionths, so that sums do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLES, SEED, UNIT, PRIME, SLICE = 10_000, 42042, 1_000_000, 2_147_483_647, 1_000
#: Up to which residue a draw gives 0, 1, 2, ... copies: PRIME times the Poisson distribution of mean 1.
STEPS = tuple(int(PRIME * sum(exp(-1) / factorial(j) for j in range(k + 1))) for k in range(9))


def copies(cluster: np.ndarray, sample: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Copies of each cluster (a row) in each sample (a column)."""
    x = (cluster[:, None] % PRIME * 1_000_003 + sample[None, :] * 7_919 + seed) % PRIME
    y = (x * x + 12_345) % PRIME * 48_271 % PRIME
    return np.searchsorted(STEPS, (y * y + x) % PRIME, "right")


def _added(parts: DataFrame) -> DataFrame:
    """The arrays of parts (slice, sums) added by slice; a task holds one array a slice."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("slice").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                part = np.frombuffer(raw, np.int64)
                total[k] = total[k] + part if k in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["slice", "sums"])

    return parts.repartition("slice").mapInArrow(add, "slice int, sums binary")


def resampled(clusters: DataFrame, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """(sample, total, weight): of clusters (cluster, total, weight; all long) the sums over each sample's copies."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, samples), np.int64)
        for batch in batches:
            cluster, total, weight = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cluster", "total", "weight"))
            for at in range(0, len(cluster), 256):
                some = slice(at, at + 256)
                for a in range(0, samples, SLICE):
                    n = copies(cluster[some], np.arange(a, min(a + SLICE, samples)), seed)
                    sums[0, a : a + SLICE] += total[some] @ n
                    sums[1, a : a + SLICE] += weight[some] @ n
        cuts = range(0, samples, SLICE)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([sums[:, a : a + SLICE].tobytes() for a in cuts], pa.binary())], ["slice", "sums"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, raw in zip(batch.column("slice").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                sums = np.frombuffer(raw, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(k * SLICE + np.arange(sums.shape[1])), pa.array(sums[0]), pa.array(sums[1])], ["sample", "total", "weight"])

    parts = clusters.select("cluster", "total", "weight").mapInArrow(draw, "slice int, sums binary")
    return _added(parts).mapInArrow(unpack, "sample long, total long, weight long")


def interval(clusters: DataFrame, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """(n_clusters, mean, low, high): the mean difference and its 95 % interval, as means in units, from `samples` resamples.

    The interval's ends are the samples at floor(p (m - 1)) of the m sorted ones; samples without a copy have no mean. Without
    clusters all are zero.
    """
    mean = F.col("total") / F.col("weight") / UNIT
    means = F.sort_array(F.collect_list(mean))  # as many as samples, however many clusters there are
    ends = resampled(clusters, samples, seed).where("weight > 0").agg(means.alias("m"))
    at = lambda p: F.coalesce(F.get("m", F.floor(F.lit(p) * (F.size("m") - 1)).cast("int")), F.lit(0.0))
    seen = clusters.agg(F.count("*").alias("n_clusters"), F.coalesce(F.sum("total") / F.sum("weight") / UNIT, F.lit(0.0)).alias("mean"))
    return seen.join(ends.select(at(0.025).alias("low"), at(0.975).alias("high")))


def by_user(rows: DataFrame) -> DataFrame:
    """Clusters whose users count alike: (cluster, total, weight) of rows (cluster, delta) is the mean of a user's differences."""
    return rows.groupBy("cluster").agg(F.round(F.avg("delta") * UNIT).cast("long").alias("total")).withColumn("weight", F.lit(1).cast("long"))


def by_query(rows: DataFrame) -> DataFrame:
    """Clusters whose queries count alike: the sum of a user's differences and their number."""
    return rows.groupBy("cluster").agg(F.sum(F.round(F.col("delta") * UNIT).cast("long")).alias("total"), F.count("*").alias("weight"))
