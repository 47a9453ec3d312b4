"""Queries cover the whole job: every 50th row as query, all rows, all chunks, all terms."""

import random

from pyspark.sql import functions as F

from evidra.operators import evidence, fulltext, vector
from evidra.operators.needles import holding
from evidra.plans import corpus, evaluation  # noqa: F401  the latter registers its queries
from evidra.plans import queries as plans

SF = "/root/testdata/sf0.001"


def test_every_50th_vector_is_a_query(spark):
    v = corpus.table(spark, SF, "embeddings")
    want = {r.vec_id for r in v.collect() if r.vec_id % 50 == 0}
    for name in ("knn_top20_multi", "legacy_dense", "ndcg_at5", "evidence_selection"):
        got = {r.query_id for r in plans.QUERIES[name](spark, SF).select("query_id").distinct().collect()}
        assert got <= want if name == "evidence_selection" else got == want


def test_knn_in_blocks_equals_knn(spark):
    v = spark.range(7).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    rows = lambda found: sorted((r.query_id, r.cand_id, r.rank) for r in found.collect())
    assert rows(vector.knn_in_blocks(v, v, 2, most=3)) == rows(vector.knn(v, v, 2))
    assert rows(vector.knn_in_blocks(v, v, 2, most=3, block=2)) == rows(vector.knn(v, v, 2))
    assert vector.knn_in_blocks(v, v.where("vec_id < 0"), 2).count() == 0
    assert vector.knn_in_blocks(v.where("vec_id < 0"), v, 2, most=3).count() == 0


def test_knn_of_many_queries_has_one_plan(spark):
    """Blocks of queries are rows: four times as many make the plan no larger, and none is collected."""
    v = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.sin("id"), F.cos("id")).alias("embedding")).repartition(3)
    size = lambda n: len(vector.knn_in_blocks(v, v.where(f"vec_id < {n}"), 5, most=10, block=16)._jdf.queryExecution().logical().toString().splitlines())
    assert size(100) == size(400)
    got = {(r.query_id, r["rank"]): r.cand_id for r in vector.knn_in_blocks(v, v, 5, most=10, block=16).collect()}
    import numpy as np

    x = np.array([[1.0, np.sin(k), np.cos(k)] for k in range(400)])
    score = (x / np.linalg.norm(x, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
    for q in range(0, 400, 7):
        want = sorted((c for c in range(400) if c != q), key=lambda c: (-score[q, c], c))[:5]
        assert np.allclose([score[q, got[q, k + 1]] for k in range(5)], [score[q, c] for c in want])


def test_full_ranking_stays_with_the_owner(spark):
    v = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [1.0, 1.0]), (3, 1, [0.0, 1.0]), (4, 2, [1.0, 0.0]), (5, 1, [0.0, 0.0]), (6, 1, None), (7, None, [1.0, 0.0])], "vec_id long, owner int, embedding array<float>")
    got = vector.ranked_within(v, v.where("vec_id in (1, 4, 5, 7)"), "owner").collect()
    assert {tuple(r) for r in got} == {(1, 1, 2, 1), (1, 1, 3, 2)}


def test_only_active_versions_are_ranked(spark):
    got = plans.QUERIES["evidence_candidates"](spark, SF).collect()
    active = {r.version_id for r in corpus.versions(corpus.table(spark, SF, "documents")).where("status = 'ACTIVE'").collect()}
    assert {r.cand_id for r in got} <= active
    for q in range(0, 500, 50):  # no place is lost to another version
        assert sorted(r.rank for r in got if r.query_id == q) == [1, 2, 3, 4, 5]


def test_evidence_past_the_first_chunk_is_found(spark):
    got = plans.QUERIES["evidence_search"](spark, SF).collect()
    assert any(r.chunk_id % 1_000_000 > 1 for r in got)
    docs = corpus.table(spark, SF, "documents")
    assert {r.query_id for r in got} <= {r.doc_id for r in docs.where("doc_id % 50 = 0").collect()}


def test_profile_reads_all_candidates_and_the_end_of_a_query(spark):
    rows = [(1, n, n, None, "", "Kafka broker retry" if n == 30 else f"none {n}", 0.1, 1) for n in range(1, 31)]
    candidates = spark.createDataFrame(rows, "query_id long, chunk_id long, version_id long, page_no int, title string, content string, score double, rank long")
    asked = spark.createDataFrame([(1, "of " * 100 + "broker retry kafka")], "query_id long, query string")
    assert [r.chunk_id for r in evidence.evidence_profile(candidates, asked, most=None).collect()] == [30]


def test_seam_equals_trying_every_length():
    rng = random.Random(7)
    for _ in range(2000):
        a, b = ("".join(rng.choices("ab", [9, 1], k=rng.randint(60, 300))) for _ in range(2))
        b = a[-rng.randint(60, 200) :] + b if rng.random() < 0.5 else b
        least = max(evidence.OVERLAP, evidence.OVERLAP_SHARE * min(len(a), len(b)))
        want = any(x.endswith(y[:k]) for x, y in ((a, b), (b, a)) for k in range(evidence.OVERLAP, min(len(a), len(b)) + 1) if k >= least)
        assert evidence._seam(a, b) == want


def test_lineage_has_all_tags_and_versions(spark):
    got = plans.QUERIES["lineage_join"](spark, SF).select("version_no", "tag_id").distinct().collect()
    assert {r.version_no for r in got} == {1, 2} and {r.tag_id for r in got} >= set(range(25))


def test_dates_are_those_of_documents(spark, tmp_path):
    rows = [(1, "From 2024-02-29 to 2024/12/05, not 2023-02-29; in 2019."), (2, "2019 and 3024, 1999-13")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.raw): r.precision for r in plans.QUERIES["date_atoms"](spark, str(tmp_path)).collect()}
    assert got == {(1, "2024-02-29"): "FULL_DATE", (1, "2024/12/05"): "FULL_DATE", (1, "2023-02-29"): None, (1, "2019"): "YEAR", (2, "2019"): "YEAR", (2, "1999-13"): None}


def test_rare_terms_have_a_frequency(spark):
    assert plans.QUERIES["doc_frequency"](spark, SF).where("df < 5").count() > 0


def test_knn_passes_over_faulty_vectors(spark):
    nan = float("nan")
    good = [(n, [1.0, float(n)]) for n in range(6)]
    bad = [(10, [0.0, 0.0]), (11, [nan, 1.0]), (12, None), (13, [1.0]), (14, [0.0, 0.0]), (15, [1.0, None])]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    q = frame(good).where("vec_id < 2")
    rows = lambda found: sorted((r.query_id, r.cand_id, r.rank) for r in found.collect())
    assert rows(vector.knn(frame(good + bad), q, 2)) == rows(vector.knn_in_blocks(frame(good + bad), q, 2)) == rows(vector.knn(frame(good), q, 2))


def test_stream_of_jobs_ends_where_the_batch_fold_does(spark):
    batch = {tuple(r) for r in plans.QUERIES["job_fold"](spark, SF).select("job_id", "status", "fence", "retries", "rejected").collect()}
    assert {tuple(r) for r in plans.QUERIES["stream_job_state"](spark, SF).select("job_id", "status", "fence", "retries", "rejected").collect()} == batch


def test_needles(spark):
    texts = spark.createDataFrame([(1, "ab bc"), (2, None), (3, ""), (1, "xx")], "d long, t string")
    needles = spark.createDataFrame([(1, "b"), (2, "b b"), (3, None), (4, ""), (5, "b")], "n long, s string")
    got = lambda most: sorted(map(tuple, holding(texts, needles, "d", "t", "n", "s", most=most).collect()))
    want = sorted([(1, 1), (5, 1), (2, 1), (4, 1), (4, 1), (4, 3)])
    assert got(100) == got(2) == want
    assert holding(texts, needles.limit(0), "d", "t", "n", "s").count() == 0


def test_cover_density_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice("abcx") for _ in range(rng.randrange(1, 14)))) for k in range(60)]
    queries = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c")], "query_id long, term string")
    got = {(r.query_id, r.id): round(r.density, 9) for r in fulltext.matches(queries, spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()}
    want = {}
    for q, terms in ((1, {"a", "b"}), (2, {"c"})):
        for k, text in rows:
            w = text.split()
            spans = [(p, e) for e in range(len(w)) for p in range(e + 1) if terms <= set(w[p : e + 1])]
            least = [(p, e) for p, e in spans if not any(p <= a and b <= e and (a, b) != (p, e) for a, b in spans)]
            if least:
                want[q, k] = round(sum(0.1 / (1 + (e - p + 1) - sum(x in terms for x in w[p : e + 1])) for p, e in least), 9)
    assert got == want


def test_fusion_keeps_one_armed_candidates(spark):
    arm = lambda rows: spark.createDataFrame(rows, "query_id long, cand_id long, rank long")
    got = fulltext.fuse(arm([(1, 5, 1), (1, 6, 2)]), arm([(1, 6, 1), (1, 7, 2)])).orderBy("pos").collect()
    assert [(r.cand_id, r.dense_rank, r.other_rank) for r in got] == [(6, 2, 1), (5, 1, None), (7, None, 2)]
