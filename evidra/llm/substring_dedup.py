"""Operator 3: exact repeated passages by fixed-block anchors.

A passage is a run of `window` words. Any such run of a reference document holds a whole block of
(window + 1) // 2 words at a multiple of that length, so blocks are indexed without overlap and probed with
every rolling run of their length.
0. Documents are packed into batches in the shared folder, so that every later step sees the same rows.
1. A batch sends, for each bucket of block hashes, its distinct rolling hashes (32 bits beside the bucket)
   and which of them start at a block; the bucket answers with a bit for each: does it occur elsewhere too,
   and as a block somewhere.
2. Around these anchors a batch extends to runs of `window` words. Within the batch runs are one where their
   words are equal; for each distinct run it sends the 128-bit BLAKE2b digest of the run's own words and the
   smallest id that has it, and the bucket answers with the smallest id of all batches. Word hashes only find
   candidates; what is removed has the digest of words of an earlier document.
3. A run is removed where that id is smaller than its document's; runs side by side make the maximal
   repeats. What is kept is joined by one space.
Each batch pre-aggregates, so a passage that many documents share costs one entry per batch.

Defined cases: null text has no words; documents of fewer than `window` words keep all; rows with equal ids
never remove each other's words; a null id counts as the largest; all columns are carried, only the
text changes (columns of the names n_words and n_removed are replaced); repeated rows give a row each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, kept_words, n_buckets, slices, spaced, stored, windows, within, word_ids, words_of

LAST = np.iinfo(np.int64).max


def _squeeze(x: np.ndarray) -> bytes:
    """Compressed, the bytes of a kind side by side."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _spread(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(data.reshape(width, -1).T).view(kind).ravel()


def batches_of(docs: DataFrame, text_col: str, limit: int = 3_000_000) -> DataFrame:
    """(batch, blob): the rows of docs in compressed Arrow batches of about limit bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(slices(batches, text_col, limit)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            blob = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([part + k], pa.int64()), pa.array([blob], pa.binary())], ["batch", "blob"])

    return docs.mapInArrow(run, "batch long, blob binary")


def _open(blob: bytes) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob))))


def _parts(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each bucket of a sorted array and where it stands."""
    found, first = np.unique(bucket, return_index=True)
    ends = np.append(first, len(bucket))[1:]
    return ((b, slice(lo, hi)) for b, lo, hi in zip(found.tolist(), first.tolist(), ends.tolist(), strict=True))


class _Anchors:
    """A batch's rolling block hashes: the distinct ones in the order of (bucket, hash)."""

    def __init__(self, batch: pa.RecordBatch, id_col: str, text_col: str, window: int, buckets: int):
        self.words = w = words_of(batch.column(text_col))
        self.ids = pc.fill_null(batch.column(id_col).cast(pa.int64()), LAST).to_numpy(zero_copy_only=False)
        self.window, self.block = window, (window + 1) // 2
        self.at = within(w.first, self.block)
        h = windows(w.hash, self.block)[self.at]
        code = (h >> np.uint64(33)) % np.uint64(buckets) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))
        self.codes, self.place, times = np.unique(code, return_inverse=True, return_counts=True)
        self.twice = times > 1
        self.is_block = np.zeros(len(self.codes), bool)
        self.is_block[self.place[(self.at - w.first[:-1][w.doc[self.at]]) % self.block == 0]] = True
        self.bucket = (self.codes >> np.uint64(32)).astype(np.int64)

    def parts(self) -> Iterator[tuple[int, slice]]:
        return _parts(self.bucket)

    def runs(self, hits: list[tuple[int, bytes]]) -> np.ndarray:
        """Starts of the runs of window words around an anchor that was hit."""
        hit = np.zeros(len(self.codes), bool)
        bits = dict(hits)
        for b, part in self.parts():
            if b in bits:
                hit[part] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=part.stop - part.start).astype(bool)
        total = len(self.words.hash)
        some = np.zeros(total + 1, np.int64)
        some[1 + self.at[hit[self.place]]] = 1
        some = np.cumsum(some)
        starts = within(self.words.first, self.window)
        reach = self.window - self.block + 1
        return starts[some[np.minimum(starts + reach, total)] > some[starts]]


def _digests(words: Words, starts: np.ndarray, n: int) -> np.ndarray:
    """Two 64-bit numbers for each run of n words: the BLAKE2b digest of the words joined by one space."""
    raw, at = spaced(words)
    found = [blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(at[starts].tolist(), (at[starts + n] - 1).tolist(), strict=True)]
    return np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)


class _Runs:
    """The distinct runs of a batch, by (bucket, digest), with the smallest id of each."""

    def __init__(self, a: _Anchors, hits: list[tuple[int, bytes]], buckets: int):
        self.starts = a.runs(hits)
        ids, n = word_ids(a.words), a.window
        h = windows(a.words.hash, n)[self.starts] if len(self.starts) else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        by, new = self.starts[order], np.ones(len(order), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        for j in range(n):
            new[1:] |= ids[by[1:] + j] != ids[by[:-1] + j]
        first = np.flatnonzero(new)
        self.own = a.ids[a.words.doc[self.starts]] if len(order) else np.zeros(0, np.int64)
        least = np.minimum.reduceat(self.own[order], first) if len(first) else np.zeros(0, np.int64)
        digest = _digests(a.words, by[first], n)
        bucket = (digest[:, 0] % np.uint64(buckets)).astype(np.int64)
        sort = np.lexsort((digest[:, 1], digest[:, 0], bucket))
        rank = np.empty(len(sort), np.int64)
        rank[sort] = np.arange(len(sort))
        self.place = np.empty(len(order), np.int64)
        self.place[order] = rank[np.cumsum(new) - 1]
        self.h, self.g, self.least, self.bucket = digest[sort, 0], digest[sort, 1], least[sort], bucket[sort]

    def parts(self) -> Iterator[tuple[int, slice]]:
        return _parts(self.bucket)


def _by_bucket(rows: DataFrame, buckets: int, answer, schema: str) -> DataFrame:
    """answer(list of rows as dicts) -> rows, for the rows of each bucket, a bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def done() -> pa.RecordBatch:
            out = answer(held)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], ["batch", "bucket", "answer"])

        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["bucket"] != row["bucket"]:
                    yield done()
                    held = []
                held.append(row)
        if held:
            yield done()

    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _anchor_answer(rows: list[dict]) -> list[tuple[int, int, bytes]]:
    keys = [np.cumsum(_spread(r["keys"], "<u4"), dtype=np.uint64).astype(np.uint32) for r in rows]
    sizes = [len(k) for k in keys]
    flag = np.concatenate([np.unpackbits(np.frombuffer(r["flags"], np.uint8)).reshape(2, -1)[:, :n] for r, n in zip(rows, sizes, strict=True)], axis=1)
    _, place, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    block, more = np.zeros(len(times), bool), times > 1
    block[place[flag[0] > 0]] = True
    more[place[flag[1] > 0]] = True
    hit = (block & more)[place]
    cuts = np.cumsum([0, *sizes])
    return [(r["batch"], r["bucket"], np.packbits(hit[a:b]).tobytes()) for r, a, b in zip(rows, cuts, cuts[1:], strict=False) if hit[a:b].any()]


def _run_answer(rows: list[dict]) -> list[tuple[int, int, bytes]]:
    h, g, least = (np.concatenate([_spread(r[c], k) for r in rows]) for c, k in (("h", "<u8"), ("g", "<u8"), ("least", "<i8")))
    order = np.lexsort((g, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
    smallest = np.minimum.reduceat(least[order], np.flatnonzero(new))
    over = np.empty_like(least)
    over[order] = smallest[np.cumsum(new) - 1]
    cuts = np.cumsum([0, *[len(_spread(r["g"], "<u8")) for r in rows]])
    return [(r["batch"], r["bucket"], _squeeze(over[a:b])) for r, a, b in zip(rows, cuts, cuts[1:], strict=False) if (over[a:b] < least[a:b]).any()]


def _gathered(answers: DataFrame, name: str) -> DataFrame:
    """(batch, name): a batch's answers, at most one per bucket."""
    return answers.groupBy("batch").agg(F.collect_list(F.struct("bucket", "answer")).alias(name))


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """docs with the kept words as text (null stays null), and n_words and n_removed. With whole, a text that loses nothing stays as it is."""
    spark = docs.sparkSession
    buckets = 2 * n_buckets(spark)
    packed = stored(batches_of(docs, text_col), "batches")
    answer = "batch long, bucket int, answer binary"

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column("batch").to_pylist(), batch.column("blob"), strict=True):
                a = _Anchors(_open(blob.as_py()), id_col, text_col, window, buckets)
                low = (a.codes & np.uint64(0xFFFFFFFF)).astype("<u4")
                rows = []
                for b, p in a.parts():
                    keys = np.diff(low[p], prepend=np.uint32(0)).astype("<u4")
                    pad = -len(keys) % 8
                    flags = np.packbits(np.pad(np.stack([a.is_block[p], a.twice[p]]), ((0, 0), (0, pad))))
                    rows.append((b, _squeeze(keys), flags.tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["batch", "bucket", "keys", "flags"])

    hits = stored(_gathered(_by_bucket(packed.mapInArrow(probe, "batch long, bucket int, keys binary, flags binary"), buckets, _anchor_answer, answer), "hits"), "hits")

    def pairs(column: pa.Array, k: int) -> list[tuple[int, bytes]]:
        return [(r["bucket"], r["answer"]) for r in column[k].as_py() or []]

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, number in enumerate(batch.column("batch").to_pylist()):
                a = _Anchors(_open(batch.column("blob")[k].as_py()), id_col, text_col, window, buckets)
                r = _Runs(a, pairs(batch.column("hits"), k), buckets)
                rows = [(b, _squeeze(r.h[p]), _squeeze(r.g[p]), _squeeze(r.least[p])) for b, p in r.parts()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(rows), pa.int64()), pa.array([x[0] for x in rows], pa.int32()), *(pa.array([x[c] for x in rows], pa.binary()) for c in (1, 2, 3))], ["batch", "bucket", "h", "g", "least"])

    runs = packed.join(hits.hint("merge"), "batch").mapInArrow(extend, "batch long, bucket int, h binary, g binary, least binary")
    smaller = stored(_gathered(_by_bucket(runs, buckets, _run_answer, answer), "smaller"), "smaller")
    extra = [f for f in docs.schema.fields if f.name not in ("n_words", "n_removed")]
    schema = T.StructType([*extra, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = _open(batch.column("blob")[k].as_py())
                a = _Anchors(rows, id_col, text_col, window, buckets)
                r = _Runs(a, pairs(batch.column("hits"), k), buckets)
                least, over = r.least.copy(), dict(pairs(batch.column("smaller"), k))
                for b, p in r.parts():
                    if b in over:
                        least[p] = _spread(over[b], "<i8")
                gone = r.starts[least[r.place] < r.own] if len(r.starts) else r.starts
                change = np.zeros(len(a.words.hash) + 1, np.int64)
                np.add.at(change, gone, 1)
                np.add.at(change, gone + window, -1)
                keep = np.cumsum(change)[:-1] == 0
                counts, first = np.diff(a.words.first), a.words.first
                kept = np.concatenate(([0], np.cumsum(keep)))
                texts = pa.array([t.decode() for t in kept_words(a.words, keep)], pa.string())
                lost = counts - np.diff(kept[first])
                old = rows.column(text_col)
                texts = pc.if_else(pa.array((lost == 0) & whole), old, pc.if_else(pc.is_valid(old), texts, pa.nulls(len(old), pa.string())))
                out = {name: rows.column(name) for name in rows.schema.names} | {text_col: texts, "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(lost, pa.int64())}
                yield pa.RecordBatch.from_arrays([out[f.name] for f in schema.fields], schema.names)

    return packed.join(hits.hint("merge"), "batch", "left").join(smaller.hint("merge"), "batch", "left").mapInArrow(remove, schema)
