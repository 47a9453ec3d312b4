"""What results show, fallbacks over variants, vetoes and decisions, on fixtures."""

import pytest
from pyspark.sql import functions as F

from evidra.functions import unicode as un
from evidra.functions import vetoes as vt
from evidra.operators import expansion


def _shown(spark, query, texts):
    rows = [(7, k, k, t) for k, t in enumerate(texts, 1)]
    chunks = spark.createDataFrame(rows, "version_id long, chunk_id long, chunk_no long, content string")
    results = spark.createDataFrame([(1, query, 7, 1)], "query_id long, query string, version_id long, chunk_id long")
    return expansion.expand(results, chunks).first()


def test_a_sufficient_result_stays(spark):
    assert _shown(spark, "장애 원인 분석", ["장애 원인 분석 을 했다.", "장애 원인 분석 을 두 번 했다."]).shown_id == 1
    assert _shown(spark, "Kafka 지연", ["Kafka 를 썼다.", "Kafka 지연 을 줄였다."]).shown_id == 1  # the result names it


def test_a_more_direct_chunk_of_the_version_is_shown(spark):
    got = _shown(spark, "장애 원인 분석", ["날씨가 좋다.", "그날 장애 원인 분석 을 하고 개선했다.", "장애 였다."])
    assert got.shown_id == 2 and "원인 분석" in got.snippet
    assert _shown(spark, "장애 원인 분석", ["날씨가 좋다.", "바람이 분다."]).shown_id == 1


def test_edges_of_expansion(spark):
    assert _shown(spark, None, [None, None]).shown_id == 1
    assert _shown(spark, "x", []) is None


def test_marks_of_summaries():
    assert expansion.is_summary("포트폴리오 전체 요약. 본문.", "본문.") and not expansion.is_summary("본문.", "본문.")
    assert expansion.is_summary("검증 기준 " + "가" * 900 + "끝", "끝") and not expansion.is_summary("검증 기준 " + "가" * 2000 + "끝", "끝")
    assert expansion.shared_phrases("장애 원인 10 20", "그 장애 원인 은 10 20") == 2  # words of one character have no weight


def test_first_variant_that_finds(spark):
    variants = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "query_id long, variant int")
    found = spark.createDataFrame([(1, 2, 5), (1, 1, 6), (1, 1, 7)], "query_id long, variant int, chunk_id long")
    assert sorted(r.chunk_id for r in expansion.first_found(variants, found).collect()) == [6, 7]


def _judge(spark, policy, query, text):
    form = lambda c: vt.flat(un.normalized(c))
    df = spark.createDataFrame([(query, text)], "q string, t string").select("q", form("q").alias("f"), form("t").alias("c"))
    return df.select(policy(F.col("q"), F.col("f"), F.col("c")).alias("v")).first().v


@pytest.mark.parametrize(
    ("query", "text", "want"),
    [
        ("Kafka 도입 근거", "Kafka 를 검토했다. 도입하지 않았다.", "DENIED_ACT"),
        ("Kafka 도입 근거", "Redis 를 도입하지 않았다.", "PASS_THROUGH"),
        ("현재 운영 중인 Kafka", "Kafka 는 deprecated 상태다.", "NOT_CURRENT"),
        ("현재 운영 중인 Kafka", "Kafka 는 deprecated 였으나 현재 다시 운영했다.", "PASS_THROUGH"),
        ("현재 Kafka", "Kafka 프로토타입 이다. 고객 에게 연결하지 못함.", "ONLY_PROTOTYPE"),
        ("지연 30% 개선", "지연 30% 라는 기록은 부재.", "DENIED_NUMBER"),
        ("", "", "PASS_THROUGH"),
        (None, None, "PASS_THROUGH"),
    ],
)
def test_veto(spark, query, text, want):
    assert _judge(spark, vt.veto, query, text) == want


@pytest.mark.parametrize(
    ("query", "text", "want"),
    [
        ("Kafka 도입", "Kafka 를 도입했다.", "ACCEPT:AFFIRMATIVE_BOUND_CLAIM"),
        ("Kafka 도입", "Redis 를 도입했다.", "REJECT:TARGET_NOT_BOUND"),
        ("Kafka 도입", "Kafka 도입 계획.", "REJECT:AFFIRMATIVE_ACTION_NOT_SUPPORTED"),
        ("현재 Kafka", "Kafka 를 사용했지만 폐기.", "REJECT:CURRENTNESS_OR_POLARITY_NOT_SUPPORTED"),
        ("지연 30% 개선", "지연을 30% 처리했다.", "ACCEPT:AFFIRMATIVE_NUMERIC_CLAIM"),
        ("지연 30% 개선", "지연 30% 는 예정.", "REJECT:NUMERIC_ASSERTION_NOT_COMPLETED"),
        ("지연 30% 개선", "지연 30% 처리 못 함.", "REJECT:NUMERIC_ASSERTION_NEGATED"),
        ("지연 30% 개선", "지연 20% 처리했다.", "REJECT:NUMERIC_VALUE_UNIT_OR_AFFIRMATION_MISSING"),
        (None, None, "REJECT:AFFIRMATIVE_ACTION_NOT_SUPPORTED"),
    ],
)
def test_decision(spark, query, text, want):
    assert _judge(spark, vt.decision, query, text) == want
