"""Operator 2: a quality classifier from positive and unlabelled documents.

A linear model over hashed byte pairs and a few shape statistics minimises the non-negative unbiased
risk: with prior p, positives P and unlabelled U it is p*l(P,+) + max(0, l(U,-) - p*l(P,-)). With the squared loss
l(z, y) = (1 - y z)^2 / 4 every term depends on its rows through their first and second moments alone, so U is all
documents, whatever their label: one pass sums their moments, in arrays of a fixed size, and the risk is minimised on
the driver. The trusted positives are labelled rows of the training folds. Nothing but the text is an input of a score.

The prior is estimated from P and U alone: a model separates half of P from U for each of several trial priors; for a
threshold t, (share of U at t or above) / (share of the other half of P at t or above) is no less than the prior but
for chance, and is taken where the bound for chance is best; the least of these is the estimate. Fitting uses it times
`margin`: an overestimate lets the negative risk vanish before junk is pushed below the threshold.

Fitting uses a bounded sample of labelled rows: the `max_rows` positives with the smallest hash of their id (a documented
bound; a top-k by Spark), one feature row an id.

Defined cases: null and empty texts have features of zero and get the model's score for these; repeated
rows and null ids are scored each; of rows of one labelled id the one with the largest features is its example; labels
with null quality or id are not used; without any positive the score is 0.5 for all; with fewer than ten the prior is 0.5; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, summed, words_of

PAIRS, SHAPES = 1024, 12
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def features(texts: pa.Array) -> np.ndarray:
    """One float32 row of PAIRS + SHAPES numbers for each text, from the whole text."""
    w = words_of(texts)
    n = len(texts)
    off = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())).to_numpy()
    edge = np.concatenate(([0], off))
    size = np.diff(edge)
    data, doc = w.data, np.repeat(np.arange(n), size)
    out = np.zeros((n, PAIRS + SHAPES), np.float32)
    if len(data) > 1:
        same = doc[1:] == doc[:-1]
        pair = (data[:-1].astype(np.uint32) * np.uint32(256) + data[1:]) * np.uint32(2654435761) >> np.uint32(22)
        count = np.bincount(doc[1:][same] * PAIRS + pair[same], minlength=n * PAIRS).reshape(n, PAIRS)
        out[:, :PAIRS] = np.sqrt(count / np.maximum(size - 1, 1)[:, None]) * 4
    share = lambda m: np.bincount(doc[m], minlength=n) / np.maximum(size, 1)
    length = (w.end - w.start).astype(float)
    words = np.diff(w.first)
    per = np.maximum(words, 1)
    wd = w.doc
    again = np.zeros(len(w.hash), bool)  # words equal to the one before
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (wd[1:] == wd[:-1])
    order = np.lexsort((w.hash, wd))
    new = np.ones(len(order), bool)
    new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (wd[order][1:] != wd[order][:-1])
    tail = _PUNCT[data[w.end - 1]] if len(data) else np.zeros(0, bool)
    at = lambda v: np.bincount(wd, weights=v, minlength=n) / per
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    shapes = [share(_PUNCT[data]), share(upper), share(digit), share(data >= 128), at(length) / 10, at(again), np.bincount(wd[order], weights=new, minlength=n) / per, at(tail), at((length == 1) & tail), np.log1p(words) / 8, share(data == 10) * 10, at(length > 20)]
    out[:, PAIRS:] = np.stack(shapes, 1)
    return out


SLOPE = math.log(7 / 3) / 0.4  # z estimates 2 * probability - 1; a probability of 0.3 is a score of 0.3
TRIALS = tuple(k / 10 for k in range(1, 10)) + (0.95,)
BINS, REACH = 2048, 3.0


@dataclass
class Model:
    weight: np.ndarray
    bias: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.float64) @ self.weight + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(SLOPE * self.raw(x), -30, 30)))


def moments(x: np.ndarray) -> np.ndarray:
    """The sum of the outer products of the rows of x with a 1 at their ends."""
    x = np.hstack([x.astype(np.float32), np.ones((len(x), 1), np.float32)])
    return (x.T @ x).astype(np.float64)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.03, decay: float = 1e-3) -> Model:
    """Minimise the non-negative risk with the squared loss by Adam, given the moments of both sets; deterministic."""
    p, u = positive / positive[-1, -1], unlabelled / unlabelled[-1, -1]
    mean = u[-1, :-1]
    spread = np.maximum(np.sqrt(np.maximum(np.diag(u)[:-1] - mean**2, 0)), 1e-2)
    turn = np.diag(np.append(1 / spread, 1.0))  # to features of mean 0 and deviation 1
    turn[-1, :-1] = -mean / spread
    p, u = turn.T @ p @ turn, turn.T @ u @ turn
    theta, m, v = np.zeros(len(p)), np.zeros(len(p)), np.zeros(len(p))
    for t in range(1, steps + 1):
        at_p, at_u = p @ theta, u @ theta
        negative = (1 + 2 * at_u[-1] + theta @ at_u) / 4 - prior * (1 + 2 * at_p[-1] + theta @ at_p) / 4
        on_negative = (u[-1] + at_u - prior * (p[-1] + at_p)) / 2
        g = prior * (at_p - p[-1]) / 2 + on_negative if negative >= 0 else -on_negative
        g[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * min(1, 2 * (1 - t / (steps + 1))) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    theta = turn @ theta
    return Model(theta[:-1], float(theta[-1]))


def _bins(z: np.ndarray) -> np.ndarray:
    return np.clip((z + REACH) * (BINS / (2 * REACH)), 0, BINS - 1).astype(np.int64)


def mixture_share(positive: np.ndarray, unlabelled: np.ndarray, chance: float = 0.1, slack: float = 0.01) -> float:
    """The share of positives among unlabelled scores, from histograms of both by rising score."""
    n, m = positive.sum(), unlabelled.sum()
    p, u = np.cumsum(positive[::-1])[::-1] / n, np.cumsum(unlabelled[::-1])[::-1] / m
    off = math.sqrt(math.log(4 / chance) / 2 / n) + math.sqrt(math.log(4 / chance) / 2 / m)
    some = np.flatnonzero(p > 0)
    best = some[np.argmin((u[some] + (1 + slack) * off) / p[some])]
    return float(min(u[best] / p[best], 1.0))


def _all_moments(docs: DataFrame, text_col: str, slices_: int = 32) -> np.ndarray:
    """moments of all texts: a fixed number of sums for each task, halves of the symmetric matrix."""
    d = PAIRS + SHAPES + 1
    half = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in slices(batches, text_col):
            total += moments(features(batch.column(text_col)))
        if total[-1, -1]:
            parts = np.array_split(total[half].astype(np.float32), slices_)
            yield pa.RecordBatch.from_arrays([pa.array(range(slices_), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["k", "v"])

    got = summed(docs.select(text_col).mapInArrow(run, "k int, v binary"), "<f4")
    out = np.zeros((d, d))
    if got:
        out[half] = np.concatenate([got[k] for k in sorted(got)])
    return out + np.triu(out, 1).T


def _all_scores(docs: DataFrame, models: list[Model], text_col: str) -> np.ndarray:
    """Histograms of the scores of all texts, one for each model."""
    sent = docs.sparkSession.sparkContext.broadcast((np.stack([m.weight for m in models], 1).astype(np.float32), np.array([m.bias for m in models])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = sent.value
        count = np.zeros((len(bias), BINS), np.uint32)
        for batch in slices(batches, text_col):
            z = _bins(features(batch.column(text_col)) @ weight + bias)
            for k in range(len(bias)):
                count[k] += np.bincount(z[:, k], minlength=BINS).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(bias)), pa.int32()), pa.array([c.tobytes() for c in count], pa.binary())], ["k", "v"])

    got = summed(docs.select(text_col).mapInArrow(run, "k int, v binary"), "<u4")
    return np.stack([got[k] for k in range(len(models))])


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def estimate_prior(docs: DataFrame, x: np.ndarray, unlabelled: np.ndarray, text_col: str = "text") -> float:
    """The share of positives among docs, from features of positives and the moments of docs."""
    models = [fit(moments(x[::2]), unlabelled, t) for t in TRIALS]
    counts = _all_scores(docs, models, text_col)
    return min(mixture_share(np.bincount(_bins(m.raw(x[1::2])), minlength=BINS), c) for m, c in zip(models, counts, strict=True))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 5_000, margin: float = 0.95, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on training folds (ids that are not held out); labels needs id_col and quality."""
    known = labels.where((F.col("quality") == 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(id_col).distinct()
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)  # at most max_rows ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            x = features(batch.column(text_col)).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.string()), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "x"])

    got = [r.x for r in rows.mapInArrow(run, "id string, x binary").groupBy("id").agg(F.max("x").alias("x")).orderBy(F.xxhash64("id"), "id").collect()]
    if not got:
        return Model(np.zeros(PAIRS + SHAPES), 0.0)
    x = np.frombuffer(b"".join(got), np.float16).reshape(len(got), -1).astype(np.float32)
    unlabelled = _all_moments(docs, text_col)
    prior = estimate_prior(docs, x, unlabelled, text_col) if len(x) >= 10 else 0.5
    return fit(moments(x), unlabelled, min(max(prior * margin, 0.01), 0.99))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted) of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            s = sent.value.score(features(batch.column(text_col)))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            yield batch.filter(pa.array(sent.value.score(features(batch.column(text_col))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
