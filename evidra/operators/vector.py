"""Vector operators: exact cosine search, validation, literals, sparse products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import stored

MAX_QUERIES = 10_000
SLAB = 512  # queries of one matrix product
WITHIN = (1_024, 512)  # vectors and queries of a pair of blocks that is scored whole
NEAR = 32  # queries that are scored at once in such a pair, so that their scores stay near the processor


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def verdict(v: Column, dim: int) -> Column:
    """OK or the first fault of a vector: EMPTY, DIMENSION, NOT_FINITE, ZERO."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNull() | (F.size(v) == 0), "EMPTY").when(F.size(v) != dim, "DIMENSION").when(bad, "NOT_FINITE").when(~F.exists(v, lambda x: x != 0), "ZERO").otherwise("OK")


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, distance, rank): one query, k nearest, ties by id; a top-k in every partition, no shuffle of vectors."""
    found = vectors.select(id_col, cosine_distance(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query])).alias("distance")).orderBy("distance", id_col).limit(k)
    return found.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_col)).cast("long"))  # of k rows


def knn(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", most: int = MAX_QUERIES) -> DataFrame:
    """(query_id, cand_id, score, rank): the k nearest of every query but itself, ties by id.

    The queries (their number is checked against `most`) are broadcast; each Arrow batch is one matrix
    product and passes on its k best per query, so that k rows per query and batch are shuffled, never pairs.
    """
    rows = queries.select(id_col, vector_col).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} queries: pass them in blocks")
    return _ranked(_found(vectors, rows, k, id_col, vector_col), k)


def knn_in_blocks(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", most: int = MAX_QUERIES, block: int = 4_096) -> DataFrame:
    """As knn, for any number of queries: up to `most` (counted) they are broadcast, beyond that blocks of queries are joined
    with blocks of vectors. The plan has the same size for any number; no more than `most` + 1 queries reach the driver."""
    rows = queries.select(id_col, vector_col).limit(most + 1).collect()
    if len(rows) <= most:
        return _ranked(_found(vectors, rows, k, id_col, vector_col), k)
    return _ranked(_joined(vectors, queries, k, id_col, vector_col, block), k)


def ranked_within(vectors: DataFrame, queries: DataFrame, group: str, id_col: str = "vec_id", vector_col: str = "embedding", blocks: tuple[int, int] = WITHIN) -> DataFrame:
    """(group, query_id, cand_id, rank): all vectors of each query's own group but itself, none cut off, ties by id.

    Vectors without a direction are in no ranking. The vectors and the queries of a group are dealt to blocks of about so many
    rows, by counts; each pair of blocks is scored at once, so a hot group is many pairs. The sums of a score are made in
    the order of the components: equal vectors have equal scores.
    """
    unit = lambda v: F.zip_with(v, F.array_repeat(norm(v), F.size(v)), lambda x, n: x.cast("double") / n)  # noqa: E731  its norm is made once
    good = lambda df: df.where(F.col(group).isNotNull() & F.col(id_col).isNotNull() & (norm(F.col(vector_col)) > 0) & (norm(F.col(vector_col)) < float("inf")))
    q = good(queries).select(F.col(group).alias("_g"), F.size(vector_col).alias("_dim"), F.col(id_col).alias("query_id"), unit(F.col(vector_col)).alias("_q"))
    c = good(vectors).select(F.col(group).alias("_g"), F.size(vector_col).alias("_dim"), F.col(id_col).alias("cand_id"), unit(F.col(vector_col)).alias("_c"))
    many = lambda df, n, name: df.groupBy("_g").agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    sizes = stored(many(c, blocks[0], "_n").join(many(q, blocks[1], "_m"), "_g"), "sizes")
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = c.join(sizes, "_g").select("_g", "_dim", own("cand_id", "_n").alias("_a"), each("_m").alias("_b"), "cand_id", "_c")
    right = q.join(sizes, "_g").select("_g", "_dim", each("_n").alias("_a"), own("query_id", "_m").alias("_b"), "query_id", "_q")
    kinds = dict(q.dtypes) | dict(c.dtypes)
    keys = ("_g", "_dim", "_a", "_b")
    schema = f"_g {kinds['_g']}, query_id {kinds['query_id']}, cand_id {kinds['cand_id']}, score double"
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_scored, schema)
    w = Window.partitionBy("_g", "query_id").orderBy(F.desc("score"), "cand_id")
    return pairs.select(F.col("_g").alias(group), "query_id", "cand_id", F.row_number().over(w).cast("long").alias("rank"))


def _scored(key: tuple, some: pa.Table, asked: pa.Table) -> pa.Table:
    """(group, query_id, cand_id, score) of all pairs of a block of unit vectors and a block of queries, but of one id."""
    matrix = lambda t, name: t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
    kinds = pa.schema([("_g", key[0].type), ("query_id", asked.schema.field("query_id").type), ("cand_id", some.schema.field("cand_id").type), ("score", pa.float64())])
    out = []
    if some.num_rows and asked.num_rows:
        v, all_q = np.ascontiguousarray(matrix(some, "_c").T), matrix(asked, "_q")
        own, ids = (t.column(n).combine_chunks() for t, n in ((some, "cand_id"), (asked, "query_id")))
        own_np = own.to_numpy(zero_copy_only=False)
        for at in range(0, len(ids), NEAR):
            q, named = all_q[at : at + NEAR], ids[at : at + NEAR]
            score = np.zeros((len(q), v.shape[1]))
            for d, row in enumerate(v):
                score += q[:, d, None] * row[None, :]
            i, j = np.nonzero(named.to_numpy(zero_copy_only=False)[:, None] != own_np[None, :])
            out.append(pa.RecordBatch.from_arrays([pa.repeat(key[0], len(i)), named.take(pa.array(i)), own.take(pa.array(j)), pa.array(score[i, j])], kinds.names))
    return pa.Table.from_batches(out, kinds)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "cand_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best(ids: np.ndarray, queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, cand_id, score): the best k of vectors for every query, and their ties; SLAB queries a matrix product."""
    with np.errstate(all="ignore"):
        v = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).T
    m = min(k, len(own))
    for at in range(0, len(ids), SLAB):
        some, q = ids[at : at + SLAB], queries[at : at + SLAB]
        score = q @ v
        score[~np.isfinite(score) | (some[:, None] == own[None, :])] = -np.inf  # NaN would be the largest
        # all that reach the k-th score, so that ties are settled by id
        i, j = np.nonzero(score >= np.partition(score, len(own) - m, axis=1)[:, len(own) - m][:, None])
        ok = np.isfinite(score[i, j])
        i, j = i[ok], j[ok]
        yield pa.RecordBatch.from_arrays([pa.array(some[i]), pa.array(own[j]), pa.array(score[i, j])], ["query_id", "cand_id", "score"])


_FOUND = "query_id long, cand_id long, score double"


def _found(vectors: DataFrame, rows: list, k: int, id_col: str, vector_col: str) -> DataFrame:
    """The best k of each Arrow batch for every query of rows, which are broadcast."""
    ids = np.array([r[0] for r in rows], np.int64)
    q = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1 if rows else 0)
    sent = vectors.sparkSession.sparkContext.broadcast((ids, q / np.linalg.norm(q, axis=1, keepdims=True) if len(q) else q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ids, all_q = sent.value
        for batch in batches:
            if not batch.num_rows or not len(all_ids):
                continue
            # a null vector, or one of another length than the queries, is no neighbour
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column(vector_col)), all_q.shape[1]))
            if batch.num_rows:
                own = batch.column(id_col).to_numpy()
                yield from _best(all_ids, all_q, own, batch.column(vector_col).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1), k)

    return vectors.select(id_col, vector_col).mapInArrow(run, _FOUND)


def _packed(rows: DataFrame, id_col: str, vector_col: str, block: int) -> DataFrame:
    """(block, dim, ids, data): up to `block` vectors of a task and one length side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                batch = whole.slice(at, block)
                sizes = pc.fill_null(pc.list_value_length(batch.column(vector_col)), 0)
                for dim in pc.unique(sizes).to_pylist():
                    if not dim:
                        continue
                    some = batch.filter(pc.equal(sizes, dim))
                    data = some.column(vector_col).flatten().to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([dim], pa.int32()), pa.array([some.column(id_col).to_numpy().astype(np.int64).tobytes()]), pa.array([data.astype(np.float64).tobytes()])], ["block", "dim", "ids", "data"])
                    number += 1

    return rows.select(id_col, vector_col).mapInArrow(run, "block long, dim int, ids binary, data binary")


def _joined(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, block: int) -> DataFrame:
    """The best k of each pair of a block of vectors and a block of queries. Blocks are dealt to places by their numbers; every
    place of vectors meets every place of queries in a task of its own."""
    v, q = _packed(vectors, id_col, vector_col, block), _packed(queries, id_col, vector_col, block)
    n_v, n_q = (-(-rows.count() // block) or 1 for rows in (vectors, queries))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    left = v.withColumn("a", own(n_v)).withColumn("b", all_of(n_q)).select("dim", "a", "b", "ids", "data")
    right = q.withColumn("b", own(n_q)).withColumn("a", all_of(n_v)).select("dim", "a", "b", "ids", "data")

    def run(some: pa.Table, asked: pa.Table) -> pa.Table:
        def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            ids = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("ids").to_pylist()])
            return ids, np.concatenate([np.frombuffer(x, np.float64) for x in t.column("data").to_pylist()]).reshape(len(ids), -1)

        out = []
        if some.num_rows and asked.num_rows:
            (own, x), (ids, y) = matrix(some), matrix(asked)
            with np.errstate(all="ignore"):
                out = list(_best(ids, y / np.linalg.norm(y, axis=1, keepdims=True), own, x, k))
        kinds = pa.schema([("query_id", pa.int64()), ("cand_id", pa.int64()), ("score", pa.float64())])
        return pa.Table.from_batches(out, kinds)

    keys = ("dim", "a", "b")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, _FOUND)


def told(queries: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Rows of queries, made once, to be broadcast where they are at most `most` (counted)."""
    q = stored(queries, "told")
    return F.broadcast(q) if q.count() <= most else q


def sparse_top(queries: DataFrame, docs: DataFrame, k: int, most: int = 1_000_000) -> DataFrame:
    """(query_id, doc_id, score, rank) of term weights (query_id, term, w) and (doc_id, term, w); rows of one term add up.

    Weights of the queries are broadcast where they are at most `most` rows (counted), so no posting of a document is
    shuffled and a frequent term meets no single task; beyond, they are joined on the term. Where docs are partitioned by
    doc_id, a document's scores are whole in one task, which passes on its best k for each query.
    """
    q = told(queries.select("query_id", "term", F.col("w").alias("_q")), most)
    scored = docs.join(q, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("_q") * F.col("w")).alias("score")).where("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def literal(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def parse_literal(text: Column) -> Column:
    return F.from_json(text, "array<float>")
