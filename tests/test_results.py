"""Highlights, context, credited nDCG, cluster bootstrap and the order of names."""

import math
import random
import re
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.functions import claim_windows as cw
from evidra.functions import presentation as pr
from evidra.operators import bootstrap, credit, eligibility, judgements
from evidra.plans.queries import searched_tags
from evidra.plans.results import tag_order

CONTENT = "Portfolio | 2023\nStack: Kafka, Redis\nemail: me@example.com\nBuilt APIs with Spring Boot\nTuned Redis caches\nTeam: 4"
LONG = "x" * 300 + " Kafka " + "y" * 300

CASES = [
    ("Redis 사용한 프로젝트", CONTENT, CONTENT, ["Portfolio | 2023", "Stack: Kafka, Redis"]),
    ("Kafka, Spring Boot 활용 경험", CONTENT, CONTENT, ["Stack: Kafka, Redis", "Built APIs with Spring Boot"]),
    ("Redis 성능 개선에 사용한 방법", CONTENT, CONTENT, ["Stack: Kafka, Redis"]),  # asks why: the claim's unit
    ("Oracle 사용한 경험", CONTENT, " Built APIs ", ["Built APIs"]),
    ("40% 줄인 Redis", "a", "Cut it by 30%. Cut Redis by 40%. Done.", ["Cut Redis by 40%."]),
    ("no names 7", "a", "One. Two.", ["One. Two."]),
    ("Kafka 사용한", f"first\n{LONG}", "s", [LONG[301 - 110 : 301 - 110 + 280].strip()]),
    ("x", "a", "  ", []),
]


def test_highlights(spark):
    rows = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(CASES)], "k int, query string, content string, snippet string")
    shown = pr.highlight(F.col("query"), F.col("content"), F.col("snippet"))
    got = rows.select("k", "content", "snippet", shown.alias("h"), pr.places_of(shown, F.col("content")).alias("at")).orderBy("k").collect()
    assert [r.h for r in got] == [c[3] for c in CASES]
    for r in got:  # only text of the result itself
        assert all(p in r.content or p in r.snippet for p in r.h)
        assert all(a < 0 or r.content[a : a + len(p)] == p for a, p in zip(r["at"], r.h, strict=True))


def test_context(spark):
    rows = [("Redis 사용한 프로젝트", CONTENT, "x"), ("q", "One. Two here. Three. Four.", "two  HERE."), ("q", CONTENT, "Team: 4"), ("q", "a\nb", "none of it"), ("q", "a", " "), ("q", None, "a")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, query string, content string, snippet string")
    got = [r.c for r in df.select("k", pr.context(F.col("query"), F.col("content"), F.col("snippet")).alias("c")).orderBy("k").collect()]
    lines = CONTENT.split("\n")
    assert got[0] == [lines[0], lines[1], *lines[3:]] and got[1] == ["One.", "Two here.", "Three."]
    assert got[2] == [lines[0], lines[1], *lines[3:]] and got[3] == ["none of it"] and got[4] == [] and got[5] == ["a"]


def test_credited_ndcg_by_brute_force(spark):
    rng = random.Random(9)
    covered, gold, want = [], [], {}
    for q in range(60):
        units = [(g, rng.randrange(4)) for g in range(rng.randrange(1, 8)) for _ in range(rng.randrange(1, 3))]
        gold += [(q, g, x) for g, x in units]
        ranks = {r: rng.sample(units, rng.randrange(len(units) + 1)) for r in range(1, rng.randrange(1, 9))}
        covered += [(q, r, t, g, x) for r, us in ranks.items() for t, (g, x) in enumerate(us)]
        taken, dcg = set(), 0.0
        for r in range(1, 6):
            free = [(x, -t, g) for t, (g, x) in enumerate(ranks.get(r, [])) if g not in taken]
            if free:
                x, _, g = max(free)
                taken.add(g)
                dcg += x / math.log2(r + 1)
        best = sorted((max(x for h, x in units if h == g) for g in {g for g, _ in units}), reverse=True)[:5]
        ideal = sum(x / math.log2(k + 2) for k, x in enumerate(best))
        if ideal:
            want[q] = dcg / ideal
    got = credit.credited_ndcg(spark.createDataFrame(covered, "query_id int, rank int, turn int, grp int, gain int"), spark.createDataFrame(gold, "query_id int, grp int, gain int"))
    assert {r.query_id: pytest.approx(r.ndcg) for r in got.collect()} == want


def test_bootstrap_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(c), float(d)) for c, d in zip(rng.integers(0, 10**12, 40).repeat(3), rng.random(120).round(3) - 0.4, strict=True)]
    clusters = bootstrap.by_query(spark.createDataFrame(rows, "cluster long, delta double").repartition(7))
    told = {r.cluster: (r.total, r.weight) for r in clusters.collect()}
    n = bootstrap.copies(np.array(list(told), np.int64), np.arange(2500))
    total, weight = (np.array([v[k] for v in told.values()]) @ n for k in (0, 1))
    got = {r["sample"]: (r.total, r.weight) for r in bootstrap.resampled(clusters, 2500).collect()}
    assert got == {k: (int(total[k]), int(weight[k])) for k in range(2500)}
    means = np.sort(total / weight) / bootstrap.UNIT
    row = bootstrap.interval(clusters, 2500).first()
    assert (row.n_clusters, row.low, row.high) == (40, pytest.approx(means[int(0.025 * 2499)]), pytest.approx(means[int(0.975 * 2499)])) and row.low < row["mean"] < row.high
    assert bootstrap.interval(clusters.limit(0), 100).first().asDict() == {"n_clusters": 0, "mean": 0.0, "low": 0.0, "high": 0.0}


def test_copies_are_poisson():
    n = bootstrap.copies(np.arange(300), np.arange(2000))
    share = np.bincount(n.ravel(), minlength=4)[:4] / n.size
    assert np.allclose(share, [math.exp(-1), math.exp(-1), math.exp(-1) / 2, math.exp(-1) / 6], atol=0.003)
    assert abs(np.corrcoef(n[:50].astype(float)) - np.eye(50)).max() < 0.12 and n.mean(1).std() < 0.04 and n.mean(0).std() < 0.08


def test_names_in_korean_order(spark):
    tags = [(1, "나무", 2), (2, "가방", 2), (3, "banana", 2), (4, "Apple", 2), (5, "apple", 2), (6, "zoo", 9), (7, "각", 2)]
    got = tag_order(spark.createDataFrame(tags, "tag_id int, name string, n int")).orderBy("place").collect()
    assert [r.name for r in got] == ["zoo", "가방", "각", "나무", "apple", "Apple", "banana"]


def test_judgements(spark):
    """The six verdicts in their order; a judgement is held against what was submitted, then against the active source."""
    said = [(1, 5, True, "b c", "a b c"), (2, 5, True, "b c", "a b c"), (3, 5, True, "x", "a b c"), (4, 5, True, "b c", "a b c"), (5, 5, True, "s", "s"), (1, 5, False, "b c", "a b c"), (1, 5, None, None, None), (1, 5, True, "b c", None), (9, 5, True, "b", "b")]
    rows = spark.createDataFrame([(k, *r) for k, r in enumerate(said)], "k int, chunk_id int, owner_id int, found boolean, sentence string, snippet string").withColumn("query_id", F.lit(7))
    given = spark.createDataFrame([(7, c) for c in (1, 1, 3, 4, 5, 9)] + [(8, 2)], "query_id int, chunk_id int")
    chunks = spark.createDataFrame([(1, 5, "a b c d"), (2, 5, "a b c"), (3, 5, "a b c"), (4, 6, "a b c"), (5, 5, "other")], "chunk_id int, owner_id int, content string")
    got = [r.status for r in judgements.verified(rows, given, chunks).orderBy("k").collect()]
    assert got == ["ACCEPTED", "CHUNK_NOT_SUBMITTED", "SENTENCE_NOT_IN_SNIPPET", "CHUNK_NOT_ACTIVE_OWNER", "SENTENCE_NOT_IN_SOURCE", "MODEL_NONE", "MODEL_NONE", "ACCEPTED", "CHUNK_NOT_ACTIVE_OWNER"]


def test_searched_tags(spark):
    tags = spark.createDataFrame([(1, None, "a_b"), (2, 3, "a_b"), (3, 4, "a_b"), (4, None, "xa_b"), (5, 3, "axb"), (6, None, "aa_b"), (7, 3, None)], "tag_id int, owner_id int, name string")
    assert [tuple(r) for r in searched_tags(tags, "a_b", 3).orderBy("pos").collect()] == [(1, "a_b", 1), (2, "a_b", 2), (6, "aa_b", 3), (4, "xa_b", 4)]
    assert searched_tags(tags, "a_b", 3, k=2).count() == 2


def test_eligibility(spark):
    """Each policy's reasons in their order."""
    sig = "struct<identifiers:array<string>,numbers:array<string>,core:array<string>,release:boolean>"
    rows = [
        ("GENERAL", (["a"], [], [], False), (["a"], [], [], False), 0.3, 9, []),  # all names are there
        ("GENERAL", (["a"], ["7"], [], False), (["a"], ["8"], [], False), 0.3, 1, ["DENSE_SCORE_BELOW_TUNING_FLOOR"]),
        ("GENERAL", ([], [], ["x", "y", "z"], False), ([], [], ["x", "z"], False), 0.3, 5, []),  # core terms of a leading one
        ("GENERAL", ([], [], ["x", "y", "z"], False), ([], [], ["x", "z"], False), 0.3, 6, ["DENSE_SCORE_BELOW_TUNING_FLOOR"]),
        ("GENERAL", ([], [], [], False), ([], [], [], False), 0.5, 20, []),
        ("COMPLETED_RELEASE_EVIDENCE", (["b", "a"], ["7"], ["x"], True), (["c"], [], [], True), 0.4, 1, ["DENSE_SCORE_BELOW_TUNING_FLOOR", "MISSING_IDENTIFIER:a", "MISSING_IDENTIFIER:b", "MISSING_NUMBER:7", "INSUFFICIENT_CORE_TERM_COVERAGE"]),
        ("COMPLETED_RELEASE_EVIDENCE", ([], [], ["x"], True), ([], [], ["x"], True), 0.9, 1, []),
        ("COMPLETED_RELEASE_EVIDENCE", ([], [], ["x"], True), ([], [], ["x"], False), 0.9, 1, ["INSUFFICIENT_CORE_TERM_COVERAGE"]),
        ("COMPLETED_RELEASE_EVIDENCE", ([], [], [], False), ([], [], [], False), 0.9, 1, ["NO_EXPLICIT_EVIDENCE_SIGNAL"]),
    ]
    df = spark.createDataFrame([(k, *r[:5]) for k, r in enumerate(rows)], f"k int, policy string, q {sig}, c {sig}, score double, rank int")
    got = df.select("k", eligibility.reasons(F.col("policy"), F.col("q"), F.col("c"), F.col("score"), F.col("rank")).alias("r")).orderBy("k").collect()
    assert [r.r for r in got] == [r[5] for r in rows]


def brute_window(query: str, text: str):
    """All windows one after the other."""
    unit = {"밀리초": "ms", "퍼센트": "%", "기가바이트": "gb", "테라바이트": "tb"}

    def signals(t):
        found = set()
        for w in re.findall(r"[^\W_][\w+#.-]*", t.lower()):
            for _ in range(2):
                bare = re.sub(cw.ENDING, "", w)
                w = bare if len(bare) >= 2 else w
            found.add(w)
        names = {n.lower() for n in re.findall(cw.NAME, t)} - {"production"}
        numbers = {(Decimal(n).normalize(), unit.get((u or "").lower(), (u or "").lower())) for n, u in re.findall(rf"(?i)(?<![^\W_])(\d+(?:\.\d+)?)\s*({cw.UNITS})?", t.replace(",", ""))}
        return names, {w for w in found if len(w) >= 2 and w not in cw.STOP and not w[0].isdigit()}, numbers

    said = [s.strip() for s in re.split(r"(?<=[.!?。！？])\s+|[\r\n]+", text) if s.strip()]
    q, best = signals(query), None
    for a in range(len(said)):
        for n in range(1, min(3, len(said) - a) + 1):
            own = [signals(s) for s in said[a : a + n]]
            score = sum(weight * len(q[k] & set().union(*(o[k] for o in own))) for k, weight in ((0, 30), (1, 3), (2, 24))) - n
            support = sum(bool(q[1] & o[1]) for o in own)
            score += 12 * support if re.search(cw.EXPLAINS, query) and support > 1 else 0
            if best is None or score > best[2]:
                best = (a + 1, a + n, score)
    return best


def test_claim_windows_by_brute_force(spark):
    rng = random.Random(12)
    bits = ["Redis 캐시를 적용했다.", "응답을 1,200 ms에서 30.50ms로", "how it works!", "P95 30.5 밀리초", "Kafka를 도입하며", "production only", "40% 감소\n", "어떻게 했나요?", "캐시에는 Redis", "7개 중 3 개", "a.b c_d", "x12 12x"]
    cases = [(" ".join(rng.choices(bits, k=rng.randint(1, 3))), " ".join(rng.choices(bits, k=rng.randint(0, 9)))) for _ in range(150)] + [("어떤 설계 절차로 Redis 캐시", "Redis 캐시. 캐시 적용. 끝.")]
    df = spark.createDataFrame([(k, q, t) for k, (q, t) in enumerate(cases)], "k int, q string, t string")
    got = df.select("k", cw.best_window(cw.signals(F.col("q")), F.col("q"), F.transform(cw.sentences(F.col("t")), cw.signals)).alias("w")).orderBy("k").collect()
    assert [r.w and tuple(r.w) for r in got] == [brute_window(q, t) for q, t in cases]
