"""Snippets, claim verdicts, manifests, and the distributed order of jobs."""

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from evidra.functions import claims as cl
from evidra.functions import snippets as sn
from evidra.functions.unicode import manifest_digest
from evidra.operators import evidence, jobs
from evidra.operators import structure as st
from evidra.sources import files

TEXT = "1. 개요\n본인은 Redis 캐시를 도입했다. 응답 시간이\n30% 감소했다! 이후 운영에 배포했다.\n\nJava, Spring, Redis\nme@x.org\nPlain sentence here. Another one? . end"


def test_sentences():
    got = [(s.block, s.text, s.alone) for s in sn.sentences_of(TEXT)]
    assert got == [(0, "1. 개요", True), (1, "본인은 Redis 캐시를 도입했다.", False), (1, "응답 시간이\n30% 감소했다!", False), (1, "이후 운영에 배포했다.", False), (2, "Java, Spring, Redis", True), (3, "me@x.org", True), (4, "Plain sentence here.", False), (4, "Another one?", False), (4, ".", False), (4, "end", False)]
    assert all(TEXT[s.start : s.end] == s.text for s in sn.sentences_of(TEXT))


def test_sentences_hold_all_ink():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choices(["a", "b c", ".", "! ", " ", "\n", "\r\n", "\n\n", "x, y z", "12"], k=rng.randint(0, 60)))
        found = sn.sentences_of(text)
        assert "".join("".join(s.text.split()) for s in found) == "".join(text.split())
        assert all(b.start >= a.end for a, b in zip(found, found[1:]))


def test_snippet():
    got = sn.snippet_of("Redis 캐시로 응답 시간을 줄였나요", TEXT)
    assert got["first"] == 1 and got["snippet"] in TEXT and got["complete"]
    plain = "Cats sleep all day. Dogs run in the park. Birds sing."
    assert sn.snippet_of("dogs run", plain)["snippet"] == "Dogs run in the park."
    assert sn.snippet_of("nothing met", plain)["snippet"] == "Cats sleep all day."  # ties: the first
    assert sn.snippet_of("x", " me@x.org ")["snippet"] == "me@x.org" and sn.snippet_of("x", "  ") is None and sn.snippet_of(None, None) is None


@pytest.mark.parametrize(
    ("query", "window", "status", "reason"),
    [
        ("Redis 캐시를 도입했나요", "Redis 캐시를 도입했다.", "SUPPORTED", "DIRECT_LOCAL_SUPPORT"),
        ("Redis 캐시를 도입했나요", "Redis 캐시는 도입하지 않았다.", "CONTRADICTED", "EXPLICIT_NEGATION_OR_NON_ADOPTION"),
        ("Redis 캐시 담당", "저는 Redis 캐시를 담당하지 않았다.", "CONTRADICTED", "EXPLICIT_OTHER_ACTOR_OR_SELF_DENIAL"),
        ("Kafka 캐시를 도입했나요", "Redis 캐시를 도입했다.", "UNCERTAIN", "REQUIRED_ENTITY_MISSING"),
        ("Redis 지연 30% 감소", "Redis 지연 20% 감소했다.", "CONTRADICTED", "NUMERIC_OR_UNIT_CONTRADICTION"),
        ("redis 캐시", "기술 스택: redis 캐시", "SUPPORTED", "STRUCTURED_TECHNOLOGY_DECLARATION"),
        (None, None, "UNCERTAIN", "NO_DIRECT_LOCAL_SUPPORT"),
    ],
)
def test_verdicts(query, window, status, reason):
    got = cl.verdict_of(query, window)
    assert (got["status"], got["reason"]) == (status, reason)
    assert bool(got["sentences"]) == (status != "UNCERTAIN")


@pytest.mark.parametrize(
    ("premise", "hypothesis", "want"),
    [("P95 was 30ms. Good.", "P95 of 20ms", "SAME_METRIC_DIFFERENT_VALUE"), ("P95 20ms 기록이 없다.", "P95 of 20ms", "EXACT_VALUE_EXPLICITLY_DENIED"), ("P95 was 20ms.", "P95 of 20ms", None), ("P99 was 30ms.", "P95 of 20ms", None), (None, "P95 20ms", None)],
)
def test_numeric_veto(premise, hypothesis, want):
    assert cl.numeric_veto_of(premise, hypothesis) == want


def test_columns_take_nulls(spark):
    rows = spark.createDataFrame([("dogs run", "Dogs run here. Cats."), (None, None), ("x", "")], "q string, t string")
    got = rows.select(sn.snippet("q", "t").alias("s"), cl.verdict("q", "t").alias("v"), cl.numeric_veto("t", "q").alias("n"), F.size(sn.sentences("t")).alias("k")).collect()
    assert [r.s.snippet for r in got] == ["Dogs run here.", None, None]
    assert all(r.v.status == "UNCERTAIN" and r.n is None for r in got) and got[0].k == 2


def test_manifest(spark):
    want = hashlib.sha256(struct.pack(">i", 1) + b"f" + struct.pack(">ii", 1, 1) + b"k" + struct.pack(">i", 7) + b"\0" + b"\1" + struct.pack(">i", 9) + struct.pack(">ii", 1, 1) + b"x" + struct.pack(">i", 0)).hexdigest()
    assert manifest_digest("f", [("k", 7, (False, None), (True, 9), ["x"])], []) == want
    rows = spark.createDataFrame([(1, "A line.\n\nAnother."), (2, "A line.\n\nAnother."), (3, "A line.\n\nanother."), (4, None)], "id long, text string")
    got = {r.id: r.digest for r in st.manifests(rows, "id").collect()}
    assert got.keys() == {1, 2, 3} and got[1] == got[2] != got[3]


def test_ranked_by_time(spark):
    rows = spark.range(500).selectExpr("id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, int(pmod(id * 37, 300))) AS ts")
    got = jobs.ranked_by_time(rows.unionByName(spark.sql("SELECT 1000L AS id, CAST(NULL AS TIMESTAMP_NTZ) AS ts")), "ts", "id", "pos").collect()
    assert [r.id for r in sorted(got, key=lambda r: r.pos)] == [1000] + [r.id for r in sorted((r for r in got if r.ts), key=lambda r: (r.ts, r.id))]
    assert sorted(r.pos for r in got) == list(range(1, 502))


def _candidate(chunk, version, content, score, rank, page=None):
    return {"query_id": 1, "query": "redis 캐시 30% 개선", "chunk_id": chunk, "version_id": version, "page_no": page, "title": "t", "content": content, "score": score, "rank": rank}


def test_profile_merges_places_and_facts_and_rescues(spark):
    rng = random.Random(1)
    a, b = ("".join(rng.choices("abcdefgh", k=800)) for _ in range(2))
    seam = a[500:] + "".join(rng.choices("ijkl", k=500))
    fact = "redis 캐시 30% 개선"
    rows = [
        _candidate(1, 1, a, 0.90, 1),
        _candidate(2, 1, seam, 0.91, 2),  # overlaps 1 at its end: one place, the better one stays
        _candidate(3, 2, seam, 0.60, 3),  # the same text of another version is another place
        _candidate(4, 3, b, 0.40, 4),  # below the floor without anchors
        _candidate(5, 4, f"{fact} 완료", 0.30, 5),  # below the floor, with all anchors
        _candidate(6, 5, f"우리는 {fact} 성공", 0.55, 6),  # the same fact as 5, above the floor
    ]
    schema = "query_id long, query string, chunk_id long, version_id long, page_no int, title string, content string, score double, rank long"
    out = evidence.evidence_profile(spark.createDataFrame(rows, schema)).orderBy("position").collect()
    assert [r.chunk_id for r in out] == [2, 6, 3]
    assert all(r.score - 0.035 <= r.ranking_score <= r.score + 0.1 for r in out)
    odd = [_candidate(1, 1, None, 0.9, 1, 3) | {"query": None, "title": None}]
    assert [r.chunk_id for r in evidence.evidence_profile(spark.createDataFrame(odd, schema)).collect()] == [1]
    assert evidence.evidence_profile(spark.createDataFrame([], schema)).count() == 0


def test_pages_of_one_document(spark):
    text = "x" * 900
    assert not evidence._same_place(*(evidence.Candidate(k, 1, k, text, 0.9, k, None, None) for k in (1, 2)))
    assert evidence._same_place(*(evidence.Candidate(k, 1, 7, text, 0.9, k, None, None) for k in (1, 2)))


@pytest.mark.parametrize(("query", "content", "low", "high"), [("저장소 개선", "저장소 병목 문제를 개선해 30% 감소했다.", 0.05, 0.065), ("저장소 개선", "me@x.org 010-1234-5678 email", -0.035, -0.03), ("저장소", "무관한 글.", -0.001, 0.0)])
def test_adjustment(query, content, low, high):
    assert low <= evidence.adjustment(query, content) <= high + 1e-12


def test_page_verdicts(spark):
    rows = [("a", 1, "text"), ("a", 2, " "), ("a", 3, "more"), ("b", 1, None), ("c", 1, "x" * 2_000_001), *(("d", k, "p") for k in range(1, 302))]
    pages = spark.createDataFrame(rows, "name string, page_no int, text string")
    assert {r["name"]: r.verdict for r in files.page_verdicts(pages).collect()} == {"a": "OK", "b": "NO_TEXT", "c": "TOO_LONG", "d": "TOO_MANY_PAGES"}
    assert sorted((r["name"], r.page_no) for r in files.readable_pages(pages).collect()) == [("a", 1), ("a", 3)]


def test_spans_are_those_of_every_stretch():
    rng = random.Random(5)
    met = 0
    for _ in range(400):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(150, 500))) for _ in range(2))
        at = rng.randint(0, len(a))
        b = b[:100] + a[at : at + rng.choice([0, 150, 199, 200, 201, 260])] + b[100:]
        short, long = sorted((a, b), key=len)
        k = max(200, -int(-len(short) * 0.3 // 1))
        want = any(short[i : i + k] in long for i in range(len(short) - k + 1))
        met += want
        assert evidence._span(a, b, 200, 0.3) == want
    assert 0 < met < 400


def test_a_query_is_read_once_for_its_candidates(monkeypatch):
    read, init = [], sn.Question.__init__
    monkeypatch.setattr(sn.Question, "__init__", lambda self, query: read.append(query) or init(self, query))
    for k in range(20):
        evidence.adjustment("how did the payment gateway improve in 2031", f"The gateway {k} was improved. Payment was faster.")
    assert len(read) == 1


def test_sentence_windows_are_rows(spark, tmp_path):
    """All stretches of one to three sentences of a block, none over a line that stands alone; a text without any keeps its row."""
    from evidra.plans import queries as plans

    text = "One runs. Two sit. Three go. Four end.\nname: x\nFive is here."
    rows = [(1, text), (2, "name: x"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = plans.QUERIES["sentence_windows"](spark, str(tmp_path)).collect()
    assert sorted((r.first, r.last) for r in got if r.doc_id == 1) == [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3), (5, 5)]
    one = [r for r in got if r.doc_id == 1]
    assert all(r.text == text[r.start : r.end] and r.text.startswith(r.first_sentence) and r.text.endswith(r.last_sentence) and (r.n, r.n_prose, r.n_blocks) == (6, 5, 2) for r in one)
    assert [(r.doc_id, r.n, r.n_prose, r.longest, r.text) for r in got if r.doc_id == 2] == [(2, 1, 0, None, None)]
    assert [(r.doc_id, r.n, r.text) for r in got if r.doc_id == 3] == [(3, None, None)]
