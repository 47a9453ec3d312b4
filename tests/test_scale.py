"""Work that must not grow faster than the input: what is computed where, how often, and how much of it is held at once."""

import math
import random
import time
from functools import reduce

import pytest
from pyspark.sql import functions as F

from evidra.functions import presentation, slices
from evidra.functions import text as tx
from evidra.operators import vector
from evidra.plans import evaluation  # noqa: F401  registers its queries
from evidra.plans.queries import QUERIES
from evidra.sources import work

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def _first(lines, mark):
    return next(k for k, line in enumerate(lines) if mark in line)


def _seconds(df):
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def _faster(spark, new, old):
    """new and old of 1,500 pairs of chunks that share what neighbours do: the best of two runs."""
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    rows = [(a := word(800), a[-120:] + word(680)) for _ in range(1500)]
    pairs = spark.createDataFrame(rows, "a string, b string").repartition(4).cache()
    took = [min(_seconds(pairs.select(f(F.col("a"), F.col("b")).alias("x"))) for _ in range(2)) for f in (new, old)]
    pairs.unpersist()
    return took[0] < 0.6 * took[1]


def _pairs(spark, least):
    """Random pairs of short texts, many with a common stretch."""
    r, rows = random.Random(1), []
    for _ in range(400):
        letters = r.choice(["a", "ab", "abcdefgh", "é한b"])
        word = lambda n: "".join(r.choice(letters) for _ in range(n))  # noqa: E731, B023
        a, b, s = word(r.randrange(60)), word(r.randrange(60)), word(r.randrange(4, 25))
        i, j = r.choice([len(a), r.randrange(len(a) + 1)]), r.choice([0, r.randrange(len(b) + 1)])
        rows.append((a[:i] + s + a[i:], b[:j] + s + b[j:], r.randrange(least, 20)))
    return spark.createDataFrame(rows, "a string, b string, k int")


def test_overlap_of_neighbours(spark):
    def longest(a, b):
        n = min(len(a), len(b))
        return next((k for k in range(n, max(6, math.ceil(n * 0.3)) - 1, -1) if a[-k:] == b[:k]), 0)

    got = _pairs(spark, 6).select("a", "b", tx.boundary_overlap(F.col("a"), F.col("b"), 6).alias("x")).collect()
    assert sum(r.x > 0 for r in got) > 50 and all(r.x == longest(r.a, r.b) for r in got)

    def tried(a, b):
        n = F.least(F.length(a), F.length(b))
        return F.size(F.filter(F.sequence(n, F.ceil(n * 0.3).cast("int"), F.lit(-1)), lambda k: F.right(a, k) == F.left(b, k)))

    assert _faster(spark, tx.boundary_overlap, tried)


def test_shared_stretches(spark):
    got = _pairs(spark, 6).select("a", "b", "k", tx.shares_stretch(F.col("a"), F.col("b"), F.col("k")).alias("x")).collect()
    assert 50 < sum(r.x for r in got) < 350
    assert all(r.x == any(r.a[i : i + r.k] in r.b for i in range(len(r.a) - r.k + 1)) for r in got)
    tried = lambda a, b: F.exists(F.sequence(F.lit(1), F.length(a) - 239), lambda i: F.contains(b, F.substring(a, i, F.lit(240))))
    assert _faster(spark, lambda a, b: tx.shares_stretch(a, b, F.lit(240)), tried)


@pytest.mark.parametrize("text", ["a.b-c_ x", "...a..b..", "c++ c# .net", "é한-글_ 1.2.", "a_-.", "", "- . _"])
def test_tokens_lose_their_trailing_marks(spark, text):
    import regex

    plain = [t.rstrip("._-") for t in regex.findall(r"[\p{L}\p{N}][\p{L}\p{N}+#._-]*", text.lower())]
    assert spark.range(1).select(tx.tokens(F.lit(text))).first()[0] == plain


@pytest.mark.parametrize("name", ["rerank_order", "ranking_boosts", "result_state"])
def test_only_candidates_are_read_for_signals(spark, name):
    lines = _plan(QUERIES[name](spark, SF))
    of_candidates = next(k for k, line in enumerate(lines) if "[0-9][0-9,]*" in line)
    above = [line for line in lines[:of_candidates] if "Join" in line]
    assert len(above) <= (name == "result_state")  # which joins the queries without candidates


def test_only_candidates_are_read_for_claim_windows(spark):
    lines = _plan(QUERIES["claim_windows_preselected"](spark, SF))
    assert _first(lines, "split(text") < _first(lines, "Join") and sum("split(text" in line for line in lines) == 1


@pytest.mark.parametrize("f", [presentation.highlight, presentation.context])
def test_a_content_is_not_cut_into_units_again_and_again(spark, f):
    rows = spark.createDataFrame([("q", "c", "s")], "query string, content string, snippet string")
    plan = "\n".join(_plan(rows.select(f(F.col("query"), F.col("content"), F.col("snippet")))))
    assert plan.count("split(content") <= 2  # 116 and 188 by units that lambdas repeat


def test_blocks_are_cut_once_for_both_counts(spark):
    lines = _plan(QUERIES["corpus_stats"](spark, SF))
    assert sum("Generate posexplode(" in line for line in lines) == 1
    assert any("Join Inner" in line and "chunk_no" in line for line in lines)


def test_a_documents_words_stay_in_its_task(spark):
    df = QUERIES["sparse_dot_topk"](spark, SF)
    df.collect()
    shuffles = [line for line in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines() if "Exchange hashpartitioning(" in line]
    assert shuffles and not any("term" in line or "hashpartitioning(query_id" in line and "doc_id" in line.split("]")[0] for line in shuffles)


def test_large_results_are_made_in_slices(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(slices, "SLICE", 10)
    texts = ["abcd", None, "efghij", "k" * 30, "", "l"]
    runs = slices._slices(pa.array(texts, pa.string()))
    assert [x for i, n in runs for x in texts[i : i + n]] == texts and runs == [(0, 3), (3, 1), (4, 2)]


def test_tasks_hold_as_many_rows_at_any_size(spark):
    for n in (100, 1000):
        parts = work.spread(spark.range(n), "id", 20).groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) > n / 40 and max(r["count"] for r in parts) < 60


def test_a_ranking_within_groups_is_scored_in_pairs_of_blocks(spark):
    rng = random.Random(4)
    rows = [(k, k % 3, [float(rng.randrange(-3, 4)) for _ in range(3)]) for k in range(90)]
    v = spark.createDataFrame(rows, "vec_id long, owner long, embedding array<double>")
    found = vector.ranked_within(v, v.where("vec_id % 2 = 0"), "owner", blocks=(7, 4))
    want = {}
    unit = {k: [x / math.sqrt(sum(y * y for y in e)) for x in e] for k, _, e in rows if any(e)}
    for q in unit:
        if q % 2 == 0:
            near = sorted((-reduce(lambda s, xy: s + xy[0] * xy[1], zip(unit[q], unit[c]), 0.0), c) for c in unit if c % 3 == q % 3 and c != q)
            want |= {(q % 3, q, c): rank for rank, (_, c) in enumerate(near, 1)}
    assert {(r.owner, r.query_id, r.cand_id): r["rank"] for r in found.collect()} == want
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_chunks_of_documents_are_cut_into_words_once(spark):
    plan = QUERIES["top2_documents"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "Generate" not in plan
