"""Operator 13: repeated lines are dropped by probes of a sharded minimal perfect hash.

A text is split at ``\\n``. A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased; it
is known by 128 keyed bits. Keys of at least `shortest` code points that at least `least` documents hold lose their lines,
except in the largest id holding them.

1. Each document gives the distinct hashes of its long lines; they are counted by partial aggregation (documents
   and largest id), so a line of every document is one row a task.
2. The repeated hashes are dealt to shards of about `shard_keys`. For each, a task builds a minimal perfect hash (bit
   arrays by level: a key takes the first level on which it falls alone; its number is the bit's rank) and puts
   fingerprints, counts and largest ids in arrays in that order: one row a shard.
3. Documents probe the arrays: a batch of documents sends one packed row of hashes to each shard, whose arrays are
   copied to as many tasks as its probes need, so neither a hot shard nor a large one is more than a task holds. A probe
   whose fingerprint differs is of a line that is not repeated.
4. The hits come back, for each document the hashes that it loses, and the texts are cut. Documents without hits are
   absent there. A document is known by its id and a hash of both, so that rows of one id do not meet.

No line is a row of a join, and nothing but the number of keys and probes reaches the driver. Defined cases: null and
empty texts are one empty line; every row counts as a document; rows that repeat an id are cut alike; null ids
count, but are the largest id of a key only if all its holders are null; other columns are not carried; an empty
table gives an empty result. Ids are numbers or strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, _SPACE, hash_words, mix, slices, stored

_KEYS = (0x243F6A8885A308D3, 0x13198A2E03707344)
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


class Lines:
    """The lines of texts: data (bytes), their borders, the line numbers' first ones per text, and keys of the long ones."""

    def __init__(self, texts: pa.Array, shortest: int):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, off, buf = texts.buffers()
        off = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8)
        self.data = np.frombuffer(buf or b"", np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        breaks = np.flatnonzero(self.data == 10)
        # a line starts with its text or behind a break, and ends before a break or with its text
        self.start = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
        self.end = np.sort(np.concatenate([off[1:], breaks]), kind="stable")
        self.count = np.searchsorted(breaks, off[1:]) - np.searchsorted(breaks, off[:-1]) + 1
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        solid = np.flatnonzero(~_SPACE[self.data])
        a, b = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end)
        solid = np.append(solid, 0)
        begin = np.where(b > a, solid[a], 0)
        stop = np.where(b > a, solid[b - 1] + 1, 0)
        points = np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))
        self.long = np.flatnonzero(points[stop] - points[begin] >= shortest)
        lowered = _LOWER[self.data]
        self.h1, self.h2 = (hash_words(lowered, begin[self.long], stop[self.long], k) for k in _KEYS)
        self.text = np.searchsorted(self.first, self.long, "right") - 1

    def distinct(self) -> np.ndarray:
        """Numbers in long of the first line of each key of each text."""
        order = np.lexsort((self.h2, self.h1, self.text))
        t, a, b = self.text[order], self.h1[order], self.h2[order]
        new = np.ones(len(order), bool)
        new[1:] = (t[1:] != t[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return order[new]


class PerfectHash:
    """A minimal perfect hash of distinct pairs of 64 bits: a number below n for each of n keys, any number for others."""

    def __init__(self, levels: list[tuple[int, np.ndarray, np.ndarray]]):
        self.levels = levels  # (bits, words of 64 bits, rank before each word)

    @staticmethod
    def place(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (mix(h1 ^ mix(h2 + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))) % np.uint64(bits)).astype(np.int64)

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        levels, before = [], 0
        while len(h1):
            bits = -(-2 * len(h1) // 64) * 64
            at = cls.place(h1, h2, len(levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            levels.append((bits, words, before + np.cumsum(ones) - ones))
            before += int(ones.sum())
            left = ~alone[at]
            h1, h2 = h1[left], h2[left]
        return cls(levels)

    def number(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), np.int64)
        left = np.arange(len(h1))
        for k, (bits, words, rank) in enumerate(self.levels):
            at = self.place(h1[left], h2[left], k, bits)
            word, shift = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> shift & np.uint64(1)).astype(bool)
            below = word[hit] & ((np.uint64(1) << shift[hit]) - np.uint64(1))
            out[left[hit]] = rank[at[hit] >> 6] + np.bitwise_count(below)
            left = left[~hit]
        return out

    def packed(self) -> bytes:
        return b"".join(bits.to_bytes(8, "little") + words.tobytes() + rank.tobytes() for bits, words, rank in self.levels)

    @classmethod
    def unpacked(cls, raw: bytes) -> PerfectHash:
        levels, at = [], 0
        while at < len(raw):
            bits = int.from_bytes(raw[at : at + 8], "little")
            levels.append((bits, np.frombuffer(raw, "<u8", bits // 64, at + 8), np.frombuffer(raw, "<i8", bits // 64, at + 8 + bits // 8)))
            at += 8 + bits // 4
        return cls(levels)


def _found(docs: DataFrame, shortest: int) -> DataFrame:
    """(h1, h2, n, top): for each batch and key its documents and its largest id."""
    kind = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lines = Lines(batch.column("text"), shortest)
            own = lines.distinct()
            table = pa.table({"h1": lines.h1[own].view(np.int64), "h2": lines.h2[own].view(np.int64), "id": batch.column("id").take(pa.array(lines.text[own]))})
            told = table.group_by(["h1", "h2"]).aggregate([([], "count_all"), ("id", "max")])
            yield from told.select(["h1", "h2", "count_all", "id_max"]).rename_columns(["h1", "h2", "n", "top"]).combine_chunks().to_batches()

    return docs.mapInArrow(run, f"h1 long, h2 long, n long, top {kind}")


def repeated(docs: DataFrame, shortest: int = 40, least: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h1, h2, n, top) of every key that at least `least` documents hold: how many they are, and their largest id."""
    found = _found(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), shortest)
    return found.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("top").alias("top")).where(F.col("n") >= least)


def _shard(shards: int) -> Column:
    return F.pmod(F.col("h2"), F.lit(shards)).cast("int")


def arrays_of(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, hash, prints, counts, tops): a minimal perfect hash of each shard's keys and the arrays it indexes."""
    kind = dict(keys.dtypes)["top"]

    def build(part: pa.Table) -> pa.Table:
        h1, h2 = (part.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        found = PerfectHash.of(h1, h2)
        order = np.argsort(found.number(h1, h2))
        counts = np.minimum(part.column("n").to_numpy()[order], 0xFFFFFFFF).astype("<u4")
        tops = part.column("top").take(pa.array(order)).combine_chunks()
        prints = mix(h1 ^ mix(h2))[order]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(tops.type)]
        row = [part.column("shard")[:1].to_pylist(), [found.packed()], [prints.astype("<u8").tobytes()], [counts.tobytes()]]
        columns = [pa.array(v, t) for v, t in zip(row, kinds[:4], strict=True)]
        columns.append(pa.ListArray.from_arrays(pa.array([0, len(tops)], pa.int32()), tops))
        return pa.table(columns, names=["shard", "hash", "prints", "counts", "tops"])

    return keys.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(build, f"shard int, hash binary, prints binary, counts binary, tops array<{kind}>")


def _probes(docs: DataFrame, shards: int, copies: int, shortest: int) -> DataFrame:
    """(shard, copy, ids, rows, text, h1, h2): the distinct hashes of a batch of documents for each shard, packed, and whose they are."""
    kind = dict(docs.dtypes)["id"]
    names = ["shard", "copy", "ids", "rows", "text", "h1", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4_000_000):
            lines = Lines(batch.column("text"), shortest)
            own = lines.distinct()
            shard = lines.h2[own].view(np.int64) % shards
            own, shard = own[order := np.argsort(shard, kind="stable")], shard[order]
            for s in np.unique(shard).tolist():
                at = own[slice(*np.searchsorted(shard, [s, s + 1]))]
                whose, text = np.unique(lines.text[at], return_inverse=True)
                ids = batch.column("id").take(pa.array(whose))
                copy = int(mix(lines.h1[at[:1]])[0] % np.uint64(copies))
                columns = [pa.array([s], pa.int32()), pa.array([copy], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
                rows = batch.column("row").to_numpy(zero_copy_only=False)[whose]
                columns += [pa.array([v.tobytes()], pa.binary()) for v in (rows, text.astype("<i4"), lines.h1[at], lines.h2[at])]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, f"shard int, copy int, ids array<{kind}>, rows binary, text binary, h1 binary, h2 binary")


def probed(shards: DataFrame, probes: DataFrame, least: int) -> DataFrame:
    """(id, row, shard, h1, h2): the keys of a shard that a document loses, packed; both tables are keyed by (shard, copy)."""
    kind = dict(probes.dtypes)["ids"][6:-1]
    arrow = _ARROW[kind]

    def probe(arrays: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if arrays.num_rows:
            table = PerfectHash.unpacked(arrays.column("hash")[0].as_py())
            prints, counts = (np.frombuffer(arrays.column(c)[0].as_py(), t) for c, t in (("prints", "<u8"), ("counts", "<u4")))
            tops = arrays.column("tops")[0].values
            for row in asked.to_batches():
                for k in range(row.num_rows):
                    kinds = (("rows", "<i8"), ("text", "<i4"), ("h1", "<u8"), ("h2", "<u8"))
                    rows, text, h1, h2 = (np.frombuffer(row.column(c)[k].as_py(), t) for c, t in kinds)
                    number = table.number(h1, h2)
                    hit = np.flatnonzero((prints[number] == mix(h1 ^ mix(h2))) & (counts[number] >= least))
                    ids = row.column("ids")[k].values
                    mine, top = ids.take(pa.array(text[hit])), tops.take(pa.array(number[hit]))
                    kept = pc.fill_null(pc.equal(mine, top), False).to_numpy(zero_copy_only=False) | pc.is_null(top).to_numpy(zero_copy_only=False)
                    hit = hit[~kept]
                    order = hit[np.argsort(text[hit], kind="stable")]
                    whose, first = np.unique(text[order], return_index=True)
                    for w, a, b in zip(whose.tolist(), first.tolist(), np.append(first, len(order))[1:].tolist(), strict=True):
                        out.append((ids[w].as_py(), int(rows[w]), arrays.column("shard")[0].as_py(), h1[order[a:b]].tobytes(), h2[order[a:b]].tobytes()))
        kinds = (arrow, pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["id", "row", "shard", "h1", "h2"])

    keys = ("shard", "copy")
    return shards.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInArrow(probe, f"id {kind}, row long, shard int, h1 binary, h2 binary")


def _cut(texts: DataFrame, shortest: int) -> DataFrame:
    """texts (id, text, lost) with kept, n_lines and n_dropped in place of text and lost."""
    kind = dict(texts.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lines = Lines(batch.column("text"), shortest)
            gone = np.zeros(len(lines.start), bool)
            for k, lost in enumerate(batch.column("lost").to_pylist()):
                if lost:
                    a, b = np.searchsorted(lines.text, [k, k + 1])
                    pairs = {p for r in lost for p in zip(np.frombuffer(r["h1"], "<u8").tolist(), np.frombuffer(r["h2"], "<u8").tolist(), strict=True)}
                    gone[lines.long[a:b]] = [p in pairs for p in zip(lines.h1[a:b].tolist(), lines.h2[a:b].tolist(), strict=True)]
            dropped = np.add.reduceat(gone, lines.first[:-1], dtype=np.int64)
            raw, kept = lines.data.tobytes(), []
            for k, (a, b) in enumerate(zip(lines.first[:-1].tolist(), lines.first[1:].tolist(), strict=True)):
                if dropped[k]:
                    kept.append(b"\n".join([raw[lines.start[i] : lines.end[i]] for i in np.flatnonzero(~gone[a:b]) + a]).decode())
                else:
                    kept.append(raw[lines.start[a] : lines.end[b - 1]].decode())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lines.count, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], ["id", "n_lines", "n_dropped", "kept"])

    return texts.mapInArrow(run, f"id {kind}, n_lines long, n_dropped long, kept string")


def drop_repeated_lines(docs: DataFrame, shortest: int = 40, least: int = 5, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = 2_000_000, task_probes: int = 200_000) -> DataFrame:
    """(id_col, n_lines, n_dropped, kept) of every row. shard_keys, task_probes: about how many keys a shard has and how
    many hashes probe it in one task (at least four for each key, so that copies of arrays stay the smaller part)."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("row"))
    found = stored(_found(docs, shortest), "lines")
    keys = stored(found.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("top").alias("top")).where(F.col("n") >= least), "keys")
    n_keys, n_probes = keys.count(), found.agg(F.sum("n")).first()[0] or 0
    shards = -(-n_keys // shard_keys) or 1
    copies = -(-n_probes // max(shards * task_probes, 4 * n_keys)) or 1
    arrays = stored(arrays_of(keys, shards), "arrays")
    spread = arrays.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    lost = probed(spread, _probes(docs, shards, copies, shortest), least)
    lost = lost.groupBy("id", "row", "shard").agg(F.first(F.struct("h1", "h2")).alias("part"))  # of equal rows one
    lost = stored(lost.groupBy("id", "row").agg(F.collect_list("part").alias("lost")), "lost").alias("l")
    same = (F.col("d.row") == F.col("l.row")) & F.col("d.id").eqNullSafe(F.col("l.id"))
    out = _cut(docs.alias("d").join(lost, same, "left").select("d.id", "text", "lost"), shortest)
    return out.withColumnRenamed("id", id_col)
