"""Operator 5: exact Jaccard join of n-gram sets by rare-first prefix filtering.

Shingles are n consecutive words (A-Z lower-cased); fewer words make one shingle of the whole sequence.
1. One pass gives each document its set's size and a key, the SHA-256 of its lower-cased words, and counts
   document frequencies of all shingles in a table of fixed size (hashed counters). Documents with the same
   words are one class.
2. Shingles are ordered by (counter, hash), rare ones first. Sets that reach the threshold share one of the
   first |x| - ceil(t |x|) + 1. Prefix shingles travel as packed arrays, one entry for each class and batch.
3. Within the entries of a shingle, those without a partner that passes the length, positional and suffix
   filter go (the suffix filter bounds the difference of two sets by their histograms over hash ranges). Entries
   are sorted by size and tried against all that the length filter leaves, the nearest first, until they have a
   partner. The rest meet at the shingle's pivot, the entry whose shingles are the most frequent on average: in a
   group of near copies nearly all shingles have the same pivot, so a class travels to few pivots.
4. Classes get their texts by their keys, one text a class, whatever their ids are. At a pivot the classes' whole
   sets, made again from the texts, are compared exactly: shingles of equal
   hashes are equal only after their words were compared. Pivots with more than `block` classes, or 600 * `block` shingles, are split into blocks, and
   every pair of blocks is a task of its own, so no group must fit one task, and no pair is a row: a task
   gives one edge to the root of each linked class.

Defined cases: null, empty and blank texts have an empty set and link with nothing; repeated rows are rows of
one class; rows with a null id link with nothing and have a null component; an empty table gives an
empty result; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, digests, free_name, least_linked, n_buckets, slices, stored, windows, within, word_ids, words_of
from .graph import components

COUNTERS, SLICES, BINS = 1 << 20, 64, 24


def shingle_sets(w: Words, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h = windows(w.hash, n)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(h[a : b - n + 1]))
        elif b > a:
            out.append(windows(w.hash[a:b], b - a, 0x9FB21C651E98DF25 + 2 * (b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def exact_shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of every distinct shingle of each document; shingles have one number if and only if their words are equal."""
    ids, hashes, count = word_ids(w), w.hash, np.diff(w.first)
    pad = np.where(count > 0, np.maximum(n - count, 0), 0)  # a short document is one shingle that ends with no words
    if pad.any():
        at = np.repeat(w.first[1:], pad)
        ids, hashes = np.insert(ids, at, -1), np.insert(hashes, at, np.uint64(0))
    first = np.concatenate(([0], np.cumsum(count + pad)))
    start = within(first, n)
    doc = np.repeat(np.arange(len(count)), np.maximum(count + pad - n + 1, 0))
    h = windows(hashes, n)[start]
    order = np.argsort(h, kind="stable")
    same, by = h[order][1:] == h[order][:-1], start[order]
    if all((~same | (ids[by[1:] + j] == ids[by[:-1] + j])).all() for j in range(n)):
        number = np.empty(len(h), np.int64)
        number[order] = np.concatenate(([0], np.cumsum(~same))) if len(h) else 0
    else:  # different words of one hash: number the sequences themselves
        number = ids[start]
        for j in range(1, n):
            _, number = np.unique(number * (len(ids) + 1) + ids[start + j] + 1, return_inverse=True)
    both = np.unique(doc * (len(h) + 1) + number)
    return both // (len(h) + 1), both % (len(h) + 1)


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1 if size else 0


def _summaries(docs: DataFrame, n: int) -> DataFrame:
    """Rows of documents (id, n, key) and of counters (slice, counts)."""
    kind = dict(docs.dtypes)["id"]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind, pa.int64())
    names = ["id", "n", "key", "slice", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(COUNTERS, np.uint32)
        for batch in slices(batches, "text"):
            words = words_of(batch.column("text"), lower=True)
            sets = shingle_sets(words, n)
            if any(len(s) for s in sets):
                count += np.bincount((np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
            m = len(sets)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests(words), pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        if count.any():
            parts = [p.tobytes() for p in count.reshape(SLICES, -1)]
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, arrow), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.binary()), pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(parts, pa.binary())], names)

    return docs.mapInArrow(run, f"id {kind}, n long, key binary, slice int, counts binary")


def _frequencies(parts: DataFrame) -> np.ndarray:
    """The counters summed over tasks; SLICES arrays of a fixed size reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(raw, np.uint32).astype(np.uint64)
                total[k] = total[k] + part if k in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(v, 0xFFFFFFFF).astype(np.uint32).tobytes() for v in total.values()], pa.binary())], ["slice", "counts"])

    parts = parts.select("slice", "counts")
    halves = parts.mapInArrow(add, "slice int, counts binary").repartition(SLICES, "slice")
    out = np.zeros((SLICES, COUNTERS // SLICES), np.uint32)
    for r in halves.mapInArrow(add, "slice int, counts binary").collect():
        out[r["slice"]] = np.frombuffer(r["counts"], np.uint32)
    return out.ravel()


_COLUMNS = (("low", "<u4"), ("high", "u1"), ("node", "<i8"), ("size", "<u4"), ("at", "<u4"), ("score", "<f4"))


def _prefixes(docs: DataFrame, counts: np.ndarray, n: int, percent: int, buckets: int) -> DataFrame:
    """(bucket, entries): packed prefix entries, once for each set in a batch; of a shingle's hash 40 bits beside its bucket."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, squeeze = sent.value, zstandard.ZstdCompressor(level=1).compress
        held: list[tuple] = []
        seen: set[bytes] = set()
        total = 0

        def flush() -> pa.RecordBatch:
            token = np.concatenate([h[0] for h in held])
            sizes = [len(h[0]) for h in held]
            node, size, score = (np.repeat(np.array([h[k] for h in held], t), sizes) for k, t in ((1, "<i8"), (2, "<u4"), (3, "<f4")))
            hist = np.repeat(np.stack([h[4] for h in held]), sizes, axis=0)
            at = np.concatenate([np.arange(k, dtype="<u4") for k in sizes])
            bucket = ((token >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            found, first = np.unique(bucket[order], return_index=True)
            rows = []
            for a, b in zip(first, [*first[1:], len(order)], strict=True):
                o = order[a:b]
                rows.append(len(o).to_bytes(4, "little") + squeeze(b"".join(x[o].tobytes() for x in (token.astype("<u4"), (token >> np.uint64(32)).astype("u1"), node, size, at, score, hist))))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(rows, pa.binary())], ["bucket", "entries"])

        for batch in slices(batches, "text"):
            words = words_of(batch.column("text"), lower=True)
            for s, key in zip(shingle_sets(words, n), digests(words), strict=True):
                if key is None or key in seen:
                    continue
                if len(seen) < 200_000:  # beyond, copies only travel more than once
                    seen.add(key)
                c = count[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]
                p = prefix_length(len(s), percent)
                hist = np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) % BINS, minlength=BINS), 255).astype(np.uint8)
                held.append((s[np.lexsort((s, c))[:p]], int.from_bytes(key[:8], "little", signed=True), len(s), float(np.log1p(c).mean()), hist))
                total += p
            if total > 400_000:
                yield flush()
                total = 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "bucket int, entries binary")


def unpack(raw: bytes) -> dict[str, np.ndarray]:
    m, data, at, out = int.from_bytes(raw[:4], "little"), zstandard.ZstdDecompressor().decompress(raw[4:]), 0, {}
    for name, kind in _COLUMNS:
        out[name] = np.frombuffer(data, kind, m, at)
        at += out[name].nbytes
    out["token"] = out.pop("low") | out.pop("high").astype(np.uint64) << np.uint64(32)
    out["hist"] = np.frombuffer(data, np.uint8, m * BINS, at).reshape(m, BINS)
    return out


def _passes(e: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of entries of the same shingle may reach the threshold."""
    a, b = e["size"][i].astype(np.int64), e["size"][j].astype(np.int64)
    ok = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    need = -(-percent * (a + b) // (100 + percent))
    ok &= 1 + np.minimum(a - e["at"][i] - 1, b - e["at"][j] - 1) + np.minimum(e["at"][i], e["at"][j]) >= need
    i, j, k = i[ok], j[ok], np.flatnonzero(ok)
    apart = np.abs(e["hist"][i].astype(np.int16) - e["hist"][j]).sum(1)
    ok[k] = apart <= (a + b - 2 * need)[k]
    return ok


def _partnered(e: dict[str, np.ndarray], rows: np.ndarray, group: np.ndarray, percent: int, step: int) -> np.ndarray:
    """Which rows (places in e, sorted by group and size) have a partner in their group that passes the filters."""
    size = e["size"][rows].astype(np.int64)
    most = 100 * size // percent  # longer sets cannot reach the threshold
    wide = int(most.max(initial=0)) + 1
    end = np.searchsorted(group * wide + size, group * wide + most, "right")
    keep, active, r = np.zeros(len(rows), bool), np.arange(len(rows)), 0
    while len(active):
        r += 1
        active = active[active + r < end[active]]
        if r % 16 == 0:  # all that follow may have partners by now
            left = np.concatenate(([0], np.cumsum(~keep)))
            active = active[~keep[active] | (left[end[active]] > left[active + r])]
        asked = active[~(keep[active] & keep[active + r])]
        for k in range(0, len(asked), step):
            j = asked[k : k + step]
            j = j[_passes(e, rows[j], rows[j + r], percent)]
            keep[j] = keep[j + r] = True
    return keep


def pivots_of(e: dict[str, np.ndarray], percent: int, step: int = 200_000) -> np.ndarray:
    """Distinct (node, pivot) of the classes that may have a partner."""
    order = np.lexsort((e["node"], -e["score"], e["token"]))
    token, node = e["token"][order], e["node"][order]
    twice = np.zeros(len(order), bool)
    twice[1:] = (token[1:] == token[:-1]) & (node[1:] == node[:-1])
    order = order[~twice]
    token = e["token"][order]
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]][: len(token)])
    size = np.diff(np.r_[first, len(order)])
    group = np.repeat(np.arange(len(first)), size)
    rows = order[size[group] > 1]
    group = group[size[group] > 1]
    rows = rows[np.lexsort((e["size"][rows], group))]
    keep = _partnered(e, rows, group, percent, step)
    return np.unique(np.stack([e["node"][rows[keep]], e["node"][order[first[group[keep]]]]], 1), axis=0)


def _meetings(entries: DataFrame, percent: int) -> DataFrame:
    """(node, pivot) from packed entries; a bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(raw: list[bytes]) -> pa.RecordBatch:
            parts = [unpack(r) for r in raw]
            found = pivots_of({k: np.concatenate([p[k] for p in parts]) for k in parts[0]}, percent)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["node", "pivot"])

        now, raw = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                if bucket != now and raw:
                    yield done(raw)
                    raw = []
                now = bucket
                raw.append(blob)
        if raw:
            yield done(raw)

    return entries.mapInArrow(run, "node long, pivot long")


def compare(owner: np.ndarray, shingle: np.ndarray, n: int, left: np.ndarray, right: np.ndarray, percent: int, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (from left, from right) of the n sets with 100 |x and y| >= percent |x or y|; a set has the shingles of its owner."""
    size = np.bincount(owner, minlength=n)
    _, place, times = np.unique(shingle, return_inverse=True, return_counts=True)
    shared = times > 1
    place, owner = (np.cumsum(shared) - 1)[place[shared[place]]], owner[shared[place]]
    common = np.zeros((len(left), len(right)), np.float32)
    a, b = np.full(n, -1), np.full(n, -1)
    a[left], b[right] = np.arange(len(left)), np.arange(len(right))
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for k in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(place, [k, k + step])
        p, o = place[lo:hi] - k, owner[lo:hi]
        x, y = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        m = a[o] >= 0
        x[a[o[m]], p[m]] = 1
        m = b[o] >= 0
        y[b[o[m]], p[m]] = 1
        common += x @ y.T
    i, j = np.nonzero((100 + percent) * common.astype(np.float64) >= percent * (size[left][:, None] + size[right][None, :]))
    i, j = left[i], right[j]
    return i, j


def _squeezed(docs: DataFrame) -> DataFrame:
    """(key, z): one text of each class, compressed for the one shuffle that carries them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches, "text"):
            texts, held = batch.column("text"), {}
            for k, key in enumerate(digests(words_of(texts, lower=True))):
                held.setdefault(key, k)
            held.pop(None, None)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([squeeze(texts[k].as_py().encode()) for k in held.values()], pa.binary())], ["key", "z"])

    return docs.select("text").mapInArrow(run, "key binary, z binary").groupBy("key").agg(F.first("z").alias("z"))


def similar_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = 1_000, with_keys: bool = False) -> DataFrame:
    """(id_col, n_shingles, component_id): components of the links of all documents. With keys also (key, component_key) of
    each row: the digest of its words and that of its component's first class; both are null for rows that link with nothing."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(docs.dtypes)["id"]
    spark = docs.sparkSession
    first = stored(_summaries(docs, n), "shingles")
    each = first.where("slice is null").select("id", "n", "key")
    counts = _frequencies(first.where("slice is not null"))
    buckets = n_buckets(spark)
    entries = _prefixes(docs.where("id is not null"), counts, n, percent, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    classes = each.where("key is not null and id is not null").groupBy("key").agg(F.min("id").alias("id"), F.max("n").alias("n")).withColumn("node", _signed("key"))
    meet = stored(_meetings(entries, percent).distinct().join(classes, "node"), "meetings")
    crowd = meet.groupBy("pivot").agg(F.count("*").alias("m"), F.sum("n").alias("volume")).where("m > 1")
    crowd = crowd.select("pivot", F.ceil(F.greatest(F.col("m") / block, F.col("volume") / (block * 600))).cast("int").alias("parts"))
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("own", o).alias("a"), F.greatest("own", o).alias("b")))
    wanted = meet.join(crowd, "pivot").select("key", "id", "pivot", "parts", F.pmod(F.xxhash64("key"), F.col("parts").cast("long")).cast("int").alias("own"))
    rows = stored(wanted, "wanted").join(_squeezed(docs.where("id is not null")).hint("merge"), "key")
    rows = rows.withColumn("p", F.explode(others)).select("pivot", "p.a", "p.b", "own", "id", "key", "z")

    def verify(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, a, b = group
        plain = zstandard.ZstdDecompressor().decompress
        words = words_of(pa.array([plain(z) for z in part["z"]], pa.large_binary()).cast(pa.large_string()), lower=True)
        owner, shingle = exact_shingles(words, n)
        own = part["own"].to_numpy()
        i, j = compare(owner, shingle, len(part), np.flatnonzero(own == a), np.flatnonzero(own == b), percent)
        root = least_linked(len(part), i, j)
        moved = np.flatnonzero(root != np.arange(len(part)))
        ids, keys = part["id"].to_numpy(), part["key"].to_numpy()
        return pd.DataFrame({"a_id": ids[moved], "a_key": keys[moved], "b_id": ids[root[moved]], "b_key": keys[root[moved]]})

    edges = rows.groupBy("pivot", "a", "b").applyInPandas(verify, f"a_id {kind}, a_key binary, b_id {kind}, b_key binary")
    node = lambda x: F.struct(F.col(f"{x}_id").alias("id"), F.col(f"{x}_key").alias("key")).alias(x)
    roots_of = components(edges.select(node("a"), node("b"))).select(F.col("node.key").alias("key"), F.col("root.id").alias("first_id"), F.col("root.key").alias("first_key"))
    labelled = classes.join(roots_of, "key", "left").select("key", F.coalesce("first_id", "id").alias("component_id"), F.coalesce("first_key", "key").alias("component_key"))
    out = each.join(stored(labelled, "labels"), "key", "left")  # read back, so that Spark may split a hot key of this join
    linked = F.col("id").isNotNull()
    keys = [F.when(linked, F.col(c)).alias(c) for c in ("key", "component_key")] if with_keys else []
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(linked, F.coalesce("component_id", "id")).cast(kind).alias("component_id"), *keys)


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near duplicates: of each component the rows of its smallest id whose words are those of its first class.

    Rows of one id with the same words (in any case and spacing) are one document: the one with the smallest text
    (then the smallest other columns) stays. Rows with a null id, and rows without words, link with nothing and stay;
    of rows of one id without words one stays, the null text before others. All columns are carried.
    """
    groups = stored(similar_components(docs, n, percent, id_col, text_col, with_keys=True), "groups")
    c = F.col(id_col)
    stays = (c == F.col("component_id")) & F.col("key").eqNullSafe(F.col("component_key"))
    known = groups.where(c.isNotNull()).groupBy(id_col).agg(F.count("*").alias("rows"), F.count(F.when(stays, 1)).alias("stay"))
    known = stored(known.where("rows > 1 or stay = 0"), "known")
    gone, again = known.where("stay = 0").select(id_col).hint("merge"), known.where("rows > 1 and stay > 0").select(id_col).hint("merge")
    key = free_name(docs, "_key")
    left = docs.join(gone, id_col, "left_anti").select(docs.columns)
    single = left.join(again, id_col, "left_anti").select(docs.columns)
    rest = _keyed(left.join(again, id_col, "left_semi").select(docs.columns), text_col, key)
    kept = groups.where(stays).join(again, id_col, "left_semi").select(id_col, F.col("key").alias(key)).distinct()
    rest = rest.alias("r").join(kept.alias("k"), (F.col(f"r.{id_col}") == F.col(f"k.{id_col}")) & F.col(f"r.{key}").eqNullSafe(F.col(f"k.{key}")), "left_semi")
    row = F.struct(*docs.columns)
    one = rest.groupBy(id_col, key).agg(F.min_by(row, F.struct(text_col, F.to_json(row))).alias("row"))
    return single.unionByName(one.select("row.*"))


def _keyed(docs: DataFrame, text_col: str, key: str) -> DataFrame:
    """docs with the digest of their lower-cased words as key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests(words_of(batch.column(text_col), lower=True)), pa.binary())], [*batch.schema.names, key])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(key, T.BinaryType())]))


def _signed(key: str) -> Column:
    """The first eight bytes of a key, little-endian, as a signed number."""
    digits = F.hex(F.substring(key, 1, 8))
    turned = F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(8)])
    high = F.conv(F.substring(turned, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(turned, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)
