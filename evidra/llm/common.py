"""Shared pieces: the shared work folder, stored intermediate tables, vectorised word and window hashes.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; as those bytes are ASCII, splitting
UTF-8 bytes and splitting characters give the same words.
"""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:  # workers share a machine's memory: give large freed blocks back at once, not at the end of the process
    _libc = ctypes.CDLL("libc.so.6")
    _libc.mallopt(-3, 1 << 20)
    pa.set_memory_pool(pa.system_memory_pool())
except OSError:
    _libc = None

_own_base: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); an own one only in local mode without it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_base.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="evidra-"))


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _remove_all() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended: nothing more can be done here
            return


atexit.register(_remove_all)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for df in tables:
        _remove(df.sparkSession, df.stored_at)
        _written.remove((df.sparkSession, df.stored_at))


def summed(parts: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Sums by k of arrays v (binary, of the numpy kind) of parts (k int, v binary): one float64 array for each k reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("k").to_pylist(), batch.column("v").to_pylist(), strict=True):
                part = np.frombuffer(raw, kind).astype(np.float64)
                total[k] = total[k] + part if k in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["k", "v"])

    return {r.k: np.frombuffer(r.v, np.float64) for r in parts.repartition("k").mapInArrow(add, "k int, v binary").collect()}


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def n_buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with pos, their place from 0 within g in the order of by (nulls first), and n, the rows of g.

    A group may be of any size: rows are sorted by range over all tasks, numbered in each, and moved up by the
    counts of the tasks before. Those counts are one row for each task and group in it.
    """
    spread = rows.repartitionByRange(n_buckets(rows.sparkSession), "g", *by).sortWithinPartitions("g", *by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for batch in batches:
            places = []
            for g, same in groupby(batch.column("g").to_pylist()):
                m = len(list(same))
                at = at if g == last else 0
                places += range(at, at + m)
                last, at = g, at + m
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "place"])

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    held = stored(spread.mapInArrow(run, f"{fields}, place long").withColumn("task", F.spark_partition_id()), "numbered")
    counts = held.groupBy("g", "task").agg(F.count("*").alias("m"))
    before = counts.selectExpr("g", "task", "coalesce(sum(m) over (partition by g order by task rows between unbounded preceding and 1 preceding), 0) as moved", "sum(m) over (partition by g) as n")
    return held.join(before, ["g", "task"]).withColumn("pos", F.col("place") + F.col("moved")).drop("place", "moved", "task")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 500_000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most about limit bytes of one string, binary or list column (a longer value stands alone)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        values = batch.column(column)
        width = pc.multiply(pc.list_value_length(values), 4) if pa.types.is_list(values.type) else pc.binary_length(values)
        size = np.cumsum(pc.fill_null(width, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    if _libc:
        _libc.malloc_trim(0)


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) of each run of rows with the same numbers in keys; the rows must be sorted by keys."""
    last, held = None, []

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.ones(n, bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        at = np.append(np.flatnonzero(new), n)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield last, joined()
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield last, joined()


def least_linked(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number that each of 0 to n - 1 reaches by the links (i, j)."""
    low = np.arange(n)
    while True:
        old = low.copy()
        np.minimum.at(low, i, old[j])
        np.minimum.at(low, j, old[i])
        low = low[low]
        if (low == old).all():
            return low


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """data: bytes; start, end: of each word; first: index of each document's first word, then the total."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(texts: pa.Array, lower: bool = False, step: int = 500_000, key: int = 0) -> Words:
    """Split texts (nulls: no words) and hash every word with 64 keyed bits; lower folds A-Z. About step bytes at a time."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, off, buf = texts.buffers()
    off = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(buf or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    if lower:
        data = _LOWER[data]
    parts, at = [], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + step, "right")) - 1)
        start, end, h = _split(data[off[at] : off[to]], off[at : to + 1] - off[at], key)
        parts.append((start + off[at], end + off[at], h))
        at = to
    start, end, h = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in enumerate((np.int64, np.int64, np.uint64)))
    return Words(data, start, end, np.searchsorted(start, off), h)


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LONG = 512  # bytes; longer words are hashed one by one


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int = 0) -> np.ndarray:
    """64-bit hashes of words: each block of eight bytes is mixed in by a step that is not linear."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    length = end - start
    h = mix(length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(key))
    left, at = np.flatnonzero(length <= _LONG), 0
    while len(left):
        h[left] = mix(h[left] ^ (blocks[start[left] + at] & _KEEP[np.minimum(length[left] - at, 8)])) + np.uint64(0x9E3779B97F4A7C15)
        at += 8
        left = left[length[left] > at]
    for k in np.flatnonzero(length > _LONG).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8, key=key.to_bytes(8, "little")).digest(), "little")
    return h


def _split(data: np.ndarray, off: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words of data; off: the texts' borders."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    space = _SPACE[data]
    inside = ~space
    before = np.ones(n, bool)
    before[1:] = space[:-1]
    after = np.ones(n, bool)
    after[:-1] = space[1:]
    start = np.flatnonzero(inside & (before | edge[:n]))
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    return start, end, hash_words(data, start, end, key)


def windows(h: np.ndarray, n: int, base: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """A 64-bit hash of every n consecutive word hashes (windows across documents too: mask them)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    p = 1
    for j in range(n):
        out += h[j : j + len(out)] * np.uint64(p)
        p = p * base & 0xFFFFFFFFFFFFFFFF
    return mix(out)


def within(first: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows of n words that lie in one document."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    shift = first[:-1] - np.concatenate(([0], np.cumsum(count)[:-1]))
    return np.arange(count.sum()) + np.repeat(shift, count)


def compact(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all words side by side, their borders)."""
    return words.data[~_SPACE[words.data]], np.concatenate(([0], np.cumsum(words.end - words.start)))


def word_ids(words: Words) -> np.ndarray:
    """A number for each word; words have the same one if and only if their bytes are equal."""
    data, edge = compact(words)
    if not len(words.start):
        return np.zeros(0, np.int64)
    big = edge[-1] >= 1 << 31
    told = pa.Array.from_buffers(pa.large_binary() if big else pa.binary(), len(edge) - 1, [None, pa.py_buffer(edge if big else edge.astype(np.int32)), pa.py_buffer(data)])
    return told.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def spaced(words: Words) -> tuple[bytes, np.ndarray]:
    """(all words, a blank after each; where each begins, and the end)."""
    data, edge = compact(words)
    out = np.full(len(data) + len(edge) - 1, 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(len(edge) - 1), np.diff(edge))] = data
    return out.tobytes(), edge + np.arange(len(edge))


def digests(words: Words) -> list[bytes | None]:
    """SHA-256 of each document's words joined by one space; None without words."""
    raw, at = spaced(words)
    at = at[words.first].tolist()
    return [hashlib.sha256(raw[a : b - 1]).digest() if b > a else None for a, b in zip(at, at[1:], strict=False)]


def kept_words(words: Words, keep: np.ndarray) -> list[bytes]:
    """Each document's kept words joined by one space."""
    data, out, start, end = words.data.tobytes(), [], words.start, words.end
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        at = np.flatnonzero(keep[a:b]) + a
        out.append(b" ".join([data[s:e] for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)]))
    return out
