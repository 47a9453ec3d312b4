"""The grammar of queries about completed releases."""

import pytest

from evidra.functions.completion import intent_of


@pytest.mark.parametrize(
    ("query", "intent", "target"),
    [
        ("주문 API를 실제로 출시한 이력이 있나요?", "SUPPORTED", ["주문", "api"]),
        ("Kafka를 출시한 이력이 있나요?", "SUPPORTED", ["kafka"]),
        ("주문 결제 시스템을 배포했나요", "SUPPORTED", ["주문", "결제", "시스템을"]),
        ("v1.2 서버 배포 경험", "SUPPORTED", ["v1.2", "서버"]),
        ("주문 배포한 직접 근거를 찾아줘", "DIRECT_EVIDENCE", ["주문"]),
        ("출시한 이력이 있나요?", "UNSUPPORTED", []),
        ("실제로 출시한 이력", "UNSUPPORTED", []),
        ("주문, API를 출시한 이력", "UNSUPPORTED", []),
        ("주문 API 배포 했나요", "UNSUPPORTED", []),
        ("주문 재배포 방법", "UNSUPPORTED", []),
        ("배포를 어떻게", "UNSUPPORTED", []),
        ("배포 자동화", "NONE", []),
        ("장애 원인", "NONE", []),
        ("Kafka 3.1 배포를 한 날짜", "FACT_QUALIFIER", []),
        ("", "NONE", []),
        (None, "NONE", []),
    ],
)
def test_intent(query, intent, target):
    got = intent_of(query)
    assert (got["intent"], got["target"]) == (intent, target)
    assert got["policy"] == ("GENERAL" if intent == "NONE" else "COMPLETED_RELEASE_EVIDENCE")
