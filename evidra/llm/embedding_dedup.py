"""Operator 6: near-duplicate embeddings by randomised-rotation binary codes.

Equal vectors are one class, and each class is coded once: a random rotation (into at least `least_bits`
dimensions) gives one sign bit a dimension and two stored correction factors: the vector's inner product with
its own code, and the step of a four-bit form of the rotated vector itself. Four-bit form and sign code of two
vectors give an unbiased estimate of their inner product, with a bound `width` deviations wide.
1. Candidates come from tables of sign bits: each of `tables` further rotations gives a key of b bits. b grows
   with the logarithm of the number of classes, so that a bucket of unrelated vectors stays small, and the number
   of tables follows from b and the wanted recall at the threshold (closer ones are found more surely). Buckets
   get codes, never vectors. The pairs whose bound reaches the threshold, and which no earlier table
   brings together, need exact recomputation; a bucket passes on only the vectors of such pairs, with a bit a partner.
2. Only these vectors are fetched, and their marked pairs are computed exactly, in double precision. No list of
   pairs is made: a bucket gives each vector's number of links and one edge to its group.
A bucket larger than `block` classes is split in blocks, and every pair of blocks is a group of its own.

Defined cases: null, zero and non-finite vectors link with nothing; vectors of another length are compared with
those of their own length; null ids are one row each and link with nothing; equal rows are vectors of one class
and link with each other; rows that repeat an id with another vector are vectors of their own; an empty table
gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, groups_of, least_linked, stored
from .graph import components

GROUP = ["dim", "t", "key", "a", "b"]
_KINDS = "dim int, t int, key long, a int, b int"


@lru_cache(64)
def rotation(dim: int, seed: int, least_bits: int = 128) -> np.ndarray:
    """A random orthonormal frame: dim dimensions into at least least_bits, a multiple of eight."""
    wide = max(least_bits, -(-dim // 8) * 8)
    return np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((wide, dim)))[0]


@lru_cache(16)
def _directions(dim: int, count: int, seed: int) -> np.ndarray:
    """count random directions, orthogonal as far as they go."""
    rng = np.random.default_rng([seed, dim, 1])
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-count // dim))])[:count]


def plan(n: int, threshold: float, recall: float = 0.999, bucket: int = 64) -> tuple[int, int]:
    """(bits, tables): 2**bits buckets of about bucket vectors; tables for the recall at the threshold."""
    bits = min(60, max(4, math.ceil(math.log2(max(n, 1) / bucket + 1))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-meet)))


def keys_of(unit: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """The key of each vector in each table."""
    signs = (unit @ _directions(unit.shape[1], bits * tables, seed).T >= 0).reshape(len(unit), tables, bits)
    return signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def units_of(x: pa.Array, dim: int) -> np.ndarray:
    v = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def encode(unit: np.ndarray, frame: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits and four-bit forms, factor, step) of unit vectors; the rounding is randomised, so unbiased."""
    turned = unit @ frame.T
    wide = turned.shape[1]
    factor = (np.abs(turned).sum(1) / math.sqrt(wide)).astype(np.float32)
    step = np.abs(turned).max(1) / 7
    dither = np.random.default_rng([seed, wide]).random(wide)
    form = np.clip(np.floor(turned / step[:, None] + dither) + 8, 0, 15).astype(np.uint8)
    return np.hstack([np.packbits(turned >= 0, axis=1), form[:, ::2] << 4 | form[:, 1::2]]), factor, step.astype(np.float32)


def decode(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signs as +-1 / sqrt(width), four-bit forms in steps)."""
    wide = packed.shape[1] * 8 // 5
    signs = np.unpackbits(packed[:, : wide // 8], axis=1).astype(np.float32) * 2 - 1
    form = np.empty((len(packed), wide), np.float32)
    form[:, ::2], form[:, 1::2] = packed[:, wide // 8 :] >> 4, packed[:, wide // 8 :] & 15
    return signs / np.float32(math.sqrt(wide)), form - 8


def estimates(form: np.ndarray, step: np.ndarray, signs: np.ndarray, factor: np.ndarray, width: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """(estimated inner products of all pairs, how far the true ones may be off)."""
    about = (form @ signs.T) * (step[:, None] / factor[None, :])
    error = np.sqrt(np.maximum(1 / factor**2 - 1, 0) / (signs.shape[1] - 1))[None, :] + step[:, None] / (2 * factor[None, :])
    return about, width * error


def _bits(rows: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), width)


def links(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.999, block: int = 2_000, seed: int = 5) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row."""
    x = F.transform(vector_col, lambda e: e.cast("double"))
    finite = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.when(finite & F.exists(x, lambda e: e != 0) & F.col(id_col).isNotNull(), x).alias("x"))
    same = rows.where("x is not null").groupBy(F.xxhash64("x").alias("h"), "x").agg(F.min("id").alias("rep"), F.count("*").alias("size"))
    same = stored(stored(same, "classes").withColumn("cid", F.monotonically_increasing_id()), "numbered")
    kind = dict(same.dtypes)["rep"]
    bits, tables = plan(same.count(), threshold, recall)
    small = np.min_scalar_type((1 << bits) - 1)

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Rows of one length, at most 2,000 at a time, with their unit vectors and keys."""
        for batch in batches:
            length = np.array(batch.column("x").value_lengths())
            for dim in np.unique(length).tolist():
                own = batch.filter(pa.array(length == dim))
                for part in (own.slice(k, 2_000) for k in range(0, own.num_rows, 2_000)):
                    unit = units_of(part.column("x"), dim)
                    yield dim, part, unit, keys_of(unit, bits, tables, seed)

    def only_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, _, unit, keys in units(batches):
            n = len(unit) * tables
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(unit))), pa.array(keys.ravel())], GROUP[:3])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*GROUP[:3], "cid", "code", "factor", "step", "keys"]
        for dim, part, unit, keys in units(batches):
            packed, factor, step = encode(unit, rotation(dim, seed), seed)
            n, code, every = len(unit), [c.tobytes() for c in packed], [k.tobytes() for k in keys.astype(small)]
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(keys[:, t]), part.column("cid"), pa.array(code, pa.binary()), pa.array(factor), pa.array(step), pa.array(every, pa.binary())], names)

    large = same.select("x").mapInArrow(only_keys, "dim int, t int, key long").groupBy(*GROUP[:3]).agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = stored(large.withColumn("parts", F.ceil(F.col("n") / block).cast("int")).drop("n"), "large")
    few = large.count() <= 50_000  # rows of four numbers: at most two megabytes are broadcast
    dealt = same.select("cid", "x").mapInArrow(deal, "dim int, t int, key long, cid long, code binary, factor float, step float, keys binary")
    dealt = dealt.join(F.broadcast(large) if few else large.hint("merge"), GROUP[:3], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("parts").cast("long")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("own", o).alias("a"), F.greatest("own", o).alias("b")))
    dealt = dealt.withColumn("p", F.explode(others)).select(*GROUP[:3], "p.a", "p.b", "own", "cid", "code", "factor", "step", "keys")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The vectors of a group that need exact recomputation: each one's place among them and a bit for each partner."""
        for group, part in groups_of(batches, GROUP):
            _, t, _, a, b = group
            n = part.num_rows
            own, cid = part.column("own").to_numpy(), part.column("cid").to_numpy()
            left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
            if n < 2 or not len(left) or not len(right):
                continue
            packed = _bits(part.column("code").to_pylist(), len(part.column("code")[0].as_py()))
            signs, form = decode(packed)
            factor, step = part.column("factor").to_numpy(), part.column("step").to_numpy()
            keys = np.frombuffer(b"".join(part.column("keys").to_pylist()), small).reshape(n, tables)
            found = []
            for k in range(0, len(left), 500):
                some = left[k : k + 500]
                about, error = estimates(form[some], step[some], signs[right], factor[right])
                i, j = np.nonzero(about + error >= threshold)
                i, j = some[i], right[j]
                use = cid[i] < cid[j] if a == b else np.ones(len(i), bool)
                i, j = i[use], j[use]
                if t:
                    use = np.concatenate([~(keys[i[m : m + 100_000], :t] == keys[j[m : m + 100_000], :t]).any(1) for m in range(0, len(i), 100_000)] or [np.zeros(0, bool)])
                    i, j = i[use], j[use]
                found.append(np.stack([i, j]))
            i, j = np.concatenate(found, 1)
            if not len(i):
                continue
            members = np.unique(np.concatenate([i, j]))
            marks = np.zeros((len(members), len(members)), bool)
            marks[np.searchsorted(members, i), np.searchsorted(members, j)] = True
            m = len(members)
            columns = [pa.array(np.full(m, v, d)) for v, d in zip(group, (np.int32, np.int32, np.int64, np.int32, np.int32), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cid[members]), pa.array(np.arange(m, dtype=np.int32)), pa.array([r.tobytes() for r in np.packbits(marks, axis=1)], pa.binary())], [*GROUP, "cid", "place", "partners"])

    wanted = stored(dealt.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(candidates, f"{_KINDS}, cid long, place int, partners binary"), "candidates")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, part in groups_of(batches, GROUP):
            n, unit = part.num_rows, units_of(part.column("x"), int(group[0]))
            marks = np.unpackbits(_bits(part.column("partners").to_pylist(), -(-n // 8)), axis=1, count=n).astype(bool)
            i, j = np.nonzero(marks)
            ok = np.concatenate([np.einsum("ij,ij->i", unit[i[k : k + 50_000]], unit[j[k : k + 50_000]]) >= threshold for k in range(0, len(i), 50_000)])
            i, j = i[ok], j[ok]
            size = part.column("size").to_numpy()
            degree = (np.bincount(i, size[j], n) + np.bincount(j, size[i], n)).astype(np.int64)
            root, met = least_linked(n, i, j), np.flatnonzero(degree)
            take = lambda c, at: part.column(c).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([take("cid", met), take("rep", met), pa.array(degree[met]), take("cid", root[met]), take("rep", root[met])], ["cid", "rep", "n", "root_cid", "root"])

    fetched = wanted.join(same.select("cid", "rep", "size", "x").hint("merge"), "cid").repartition(*GROUP).sortWithinPartitions(*GROUP, "place")
    found = stored(fetched.mapInArrow(exact, f"cid long, rep {kind}, n long, root_cid long, root {kind}"), "links")
    discard(wanted, large)
    degree = found.groupBy("cid").agg(F.sum("n").alias("n"))
    node = lambda i, c: F.struct(F.col(i).alias("id"), F.col(c).alias("cid"))
    group = components(found.select(node("rep", "cid").alias("a"), node("root", "root_cid").alias("b"))).select(F.col("node.cid").alias("cid"), F.col("root.id").alias("root"))
    classed = same.select("x", "h", "rep", "size", "cid").join(degree, "cid", "left").join(group, "cid", "left")
    classed = classed.select("h", "x", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("root", "rep").alias("component"))
    out = rows.withColumn("h", F.xxhash64("x")).join(classed.hint("merge"), ["h", "x"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
