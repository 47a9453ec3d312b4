"""Operator 11: the best documents of each item by Fagin's threshold algorithm over impact-sorted lists.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased. A
term's weight is w = floor(1000 ln((2 N + 2) / (2 df + 1))), a document's m = 25 + (75 n N) div L, and the score of a
document sums w * ((10^9 tf) div (1000 tf + 8 m)) over the terms of the item, repeats included.

1. Documents are indexed in shards, a slice of a task each: a dictionary, and a forward index of terms and
   their numbers for each document. The index knows nothing of the items; N, L and df are sums over its shards.
2. Every shard meets every block of items, a task each: shards are copied once for each block and items once for
   each shard, so neither an index nor a set of items of any size is broadcast or collected.
3. There the lists of the items' terms are sorted by impact. The lists of an item are read round-robin, `step` entries
   each in a round; documents seen for the first time are looked up in the forward index, which gives whole scores.
   The reading ends when the threshold, the score of a document at the places reached in all lists, lies strictly below
   the k-th best score, so that no tie is lost, or when the lists end.
4. The best k of each shard are ranked together, first within tasks.

All numbers but w are 64-bit integers. Defined cases: null and empty texts have no terms, count nowhere and are
never found; items without terms, or none of whose terms is found, have no rows; rows that repeat an item id
are one item with all their terms; rows that repeat a doc id are documents of their own, ranked in any order where
scores tie; null ids rank behind others of the same score; other columns are not carried; without documents or
items the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, compact, numbered, slices, stored, words_of

SEPARATORS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 32


def terms(text: Column) -> Column:
    """The terms of a short text as an array, repeats included."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _A_Z, _A_Z.lower()), F.lit(SEPARATORS), F.lit(0))


def _terms_of(texts: pa.Array) -> Words:
    """The terms of many texts: every byte that is no part of a term is read as a blank."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, off, buf = texts.buffers()
    off = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8)
    data = _FOLD[np.frombuffer(buf or b"", np.uint8)[off[0] : off[-1]]]
    return words_of(pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(off - off[0]), pa.py_buffer(data)]))


def _index(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """(shard, docs, words, terms, df, ids, packed): packed holds for each document its n and distinct terms, then all terms
    (numbers in terms) and how often each occurs."""
    kind = dict(docs.dtypes)["id"]
    names = ["shard", "docs", "words", "terms", "df", "ids", "packed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, squeeze = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, "text", shard_bytes):
            w = _terms_of(batch.column("text"))
            n = np.diff(w.first)
            if not n.any():
                continue
            data, edge = compact(w)
            told = pa.Array.from_buffers(pa.large_string(), len(edge) - 1, [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
            number = told.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            width = len(told.dictionary)
            both, tf = np.unique(w.doc * width + number, return_counts=True)
            doc, term = both // width, both % width
            packed = b"".join(v.astype("<i4").tobytes() for v in (n, np.bincount(doc, minlength=len(n)), term, tf))
            ids = batch.column("id")
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            columns = [pa.array([made], pa.int64()), pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64())]
            columns += [one(told.dictionary.cast(pa.string())), one(pa.array(np.bincount(term, minlength=width), pa.int64())), one(ids), pa.array([squeeze(packed)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)
            made += 1

    return docs.mapInArrow(run, f"shard long, docs long, words long, terms array<string>, df array<long>, ids array<{kind}>, packed binary")


class Shard:
    """One shard of the index: forward index, and inverted lists sorted by impact, made when first asked for."""

    def __init__(self, terms: pa.Array, packed: bytes, n_docs: int, total_docs: int, total_words: int):
        self.terms = terms
        flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<i4").astype(np.int64)
        n, size, rest = flat[:n_docs], flat[n_docs : 2 * n_docs], flat[2 * n_docs :]
        self.m = 25 + (75 * n * total_docs) // total_words
        self.first = np.concatenate(([0], np.cumsum(size)))
        self.term, self.tf = rest[: len(rest) // 2], rest[len(rest) // 2 :]
        doc = np.repeat(np.arange(n_docs), size)
        self.part = (1_000_000_000 * self.tf) // (1000 * self.tf + 8 * self.m[doc])
        order = np.argsort(self.term, kind="stable")
        self.by_term, self.doc = order, doc
        self.list_first = np.searchsorted(self.term[order], np.arange(len(terms) + 1))
        self.sorted: dict[int, np.ndarray] = {}

    def impacts(self, term: int) -> np.ndarray:
        """Places in the index of a term's entries, the highest impact first."""
        if term not in self.sorted:
            at = self.by_term[self.list_first[term] : self.list_first[term + 1]]
            self.sorted[term] = at[np.argsort(-self.part[at], kind="stable")]
        return self.sorted[term]

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Random lookups: whole scores of docs from their rows of the forward index; weight is by term, 0 for others."""
        size = self.first[docs + 1] - self.first[docs]
        at = np.repeat(self.first[docs] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        gain = np.concatenate(([0], np.cumsum(weight[self.term[at]] * self.part[at])))
        ends = np.cumsum(size)
        return gain[ends] - gain[ends - size]


def threshold_top(shard: Shard, term: np.ndarray, weight: np.ndarray, k: int, step: int, slow: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, entries read): all documents that may be among the k best of an item with these terms of the shard
    and weights (repeats multiplied in); slow is an array of zeros, one for each term of the shard."""
    slow[term] = weight
    lists = [shard.impacts(t) for t in term.tolist()]
    seen = np.zeros(len(shard.m), bool)
    docs, scores, at, read = [], [], 0, 0
    best = np.zeros(0, np.int64)
    while True:
        parts = [x[at : at + step] for x in lists]
        now = np.concatenate(parts)
        read += len(now)
        fresh = np.unique(shard.doc[now])
        fresh = fresh[~seen[fresh]]
        if len(fresh):
            seen[fresh] = True
            got = shard.scores(fresh, slow)
            docs.append(fresh)
            scores.append(got)
            best = np.sort(np.concatenate([best, got]))[-k:]
        at += step
        open_lists = [j for j, x in enumerate(lists) if len(x) > at]
        if not open_lists:
            break
        # a list that has ended adds nothing to an unseen document
        threshold = sum(int(weight[j]) * int(shard.part[lists[j][at - 1]]) for j in open_lists)
        if len(best) == k and threshold < best[0]:
            break
    slow[term] = 0
    docs, scores = np.concatenate(docs), np.concatenate(scores)
    good = scores > 0
    if len(best) == k:
        good &= scores >= best[0]
    return docs[good], scores[good], read


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 8_000_000, block: int = 1_000, step: int = 64) -> DataFrame:
    """(item_col, rank, id_col, score): the k best documents of each item. block: items of one task; shard_bytes: text of a
    shard; step: entries of each list read in a round. They change nothing in the result."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_kind, item_kind = dict(docs.dtypes)["id"], dict(items.dtypes)[item_col]
    index = stored(_index(docs, shard_bytes), "index")
    asked = items.select(F.col(item_col).alias("item"), F.explode(terms(F.col(text_col))).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))
    asked = stored(asked, "asked")
    held = index.select(F.explode(F.arrays_zip("terms", "df")).alias("e")).select(F.col("e.terms").alias("term"), F.col("e.df").alias("df"))
    df = held.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    total = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0)), F.count("*")).first()
    total_docs, total_words, n_shards = total[0], total[1], total[2]
    w = F.floor(1000 * F.log((2 * F.lit(total_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = asked.join(df, "term").select("item", "term", (w * F.col("times")).alias("weight")).where("weight > 0")
    packed = stored(weighed.groupBy("item").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights")), "items")
    blocks = -(-packed.count() // block) or 1
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    places = numbered(index.select(F.lit("").alias("g"), "shard"), ["shard"]).select("shard", F.col("pos").cast("int").alias("place"))
    left = index.join(places, "shard").withColumn("block", numbers(blocks)).select("block", "place", "terms", "ids", "packed")
    right = packed.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")).withColumn("place", numbers(n_shards)).select("block", "place", "item", F.col("terms").alias("asked"), "weights")

    def search(shards: pa.Table, part: pa.Table) -> pa.Table:
        found: list[tuple] = []
        ids_type, item_type = shards.schema.field("ids").type.value_type, part.schema.field("item").type
        for j in range(shards.num_rows if part.num_rows else 0):
            ids, own = shards.column("ids")[j].values, shards.column("terms")[j].values
            shard = Shard(own, shards.column("packed")[j].as_py(), len(ids), total_docs, total_words)
            zeros = np.zeros(len(own), np.int64)
            wanted = part.column("asked").combine_chunks()
            number = pc.index_in(wanted.flatten(), own)
            sizes = np.concatenate(([0], np.cumsum(pc.list_value_length(wanted).to_numpy(zero_copy_only=False))))
            number = pc.fill_null(number, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            weights = part.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            for i, item in enumerate(part.column("item")):
                at = np.arange(sizes[i], sizes[i + 1])
                at = at[number[at] >= 0]
                if len(at):
                    d, s, _ = threshold_top(shard, number[at], weights[at], k, step, zeros)
                    own_best = pa.table([ids.take(pa.array(d)), pa.array(s)], ["id", "score"])
                    own_best = own_best.take(pc.sort_indices(own_best, [("score", "descending"), ("id", "ascending")])[:k])
                    found.append((pa.array([item.as_py()] * len(own_best), item_type), *(c.combine_chunks() for c in own_best.columns)))
        columns = [pa.concat_arrays([f[c] for f in found]) if found else pa.array([], t) for c, t in enumerate((item_type, ids_type, pa.int64()))]
        return pa.table(columns, names=["item", "id", "score"])

    keys = ("block", "place")
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, f"item {item_kind}, id {id_kind}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)  # each task keeps k before the shuffle
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
