"""Evidence chosen by typed state, and its matching against the column version of it."""

import pytest
from pyspark.sql import functions as F

from evidra.functions import typed_values as tv
from evidra.operators import selection as sel
from evidra.operators import typed


@pytest.mark.parametrize(
    ("query", "passages", "state", "chosen"),
    [
        ("tell me more", [["a", "b"], ["c"]], "UNASSESSED", [(0, 0), (0, 1), (1, 0)]),
        ("Kafka 3.2", [["on Kafka 2.8"], ["plain", "on Kafka 3.2"]], "FOUND", [(1, 1)]),
        ("Kafka 3.2", [["on Kafka 2.8"], ["Kafka 1"]], "NONE", [(0, 0), (1, 0)]),
        ("Kafka 3.2", [["on Kafka 2.8"], ["Redis 7"]], "NONE", [(0, 0)]),
        ("Kafka 3.2", [["plain"], ["Redis 7"]], "PARTIAL", [(0, 0), (1, 0)]),
        ("Kafka 3.2 Redis 7", [["plain"], ["Kafka 3.2"]], "PARTIAL", [(1, 0)]),  # only what is related
        ("Kafka 3.2 Redis 7", [["Kafka 3.2", "Redis 7"]], "FOUND", [(0, 0), (0, 1)]),  # together
        ("Kafka 3.2 Redis 7", [["Kafka 3.2 Redis 6", "Kafka 3.2", "Redis 7"]], "FOUND", [(0, 1), (0, 2)]),
    ],
)
def test_select(query, passages, state, chosen):
    assert sel.select(query, passages) == (state, chosen)


def test_select_evidence(spark):
    rows = [(1, "Kafka 3.2", 1, 1, 10, "Kafka 3.2"), (1, "Kafka 3.2", 2, 1, 10, "Kafka 3.2"), (1, "Kafka 3.2", 2, 2, 11, "Kafka 3.2"), (2, None, 1, 1, 20, None), *((3, "", 1, k, 30 + k, "t") for k in range(9)), (4, "Kafka 3.2 Redis 7", 1, 1, 40, "Kafka 3.2"), (4, "Kafka 3.2 Redis 7", 1, 2, 41, "Kafka 2 Redis 6")]
    ranked = spark.createDataFrame(rows, "query_id long, query string, passage_rank int, child_no int, child_id long, content string")
    got = {}
    for r in sel.select_evidence(ranked).orderBy("query_id", "position").collect():
        got.setdefault((r.query_id, r.state), []).append(r.child_id)
    assert got == {(1, "FOUND"): [10, 11], (2, "UNASSESSED"): [20], (3, "UNASSESSED"): [30, 31, 32, 33, 34], (4, "NONE"): [41]}
    assert sel.select_evidence(ranked.limit(0)).count() == 0


def test_match_equals_columns(spark):
    queries = ["reduce latency by at least 20%", "since 2021-05", "after 2021", "before 2020-03", "Kafka 3.2", '"x y"', "over 5 users", "users 3~9 days", "2021년 이후", "5 days"]
    texts = ["mean latency reduced by 30%", "latency increased by 30%", "latency 30%", "since 2021-05-03", "2021-05", "2020-02", "2022년", "Kafka 3.2", "Kafka 2", '"xy"', "7 users.", "users 4 days", "5 days", "6 days"]
    rows = spark.createDataFrame([(q, t) for q in queries for t in texts], "q string, t string")
    got = rows.select("q", "t", F.explode(tv.constraints("q")).alias("c"), "t").select("q", "c", F.explode(tv.observations("t")).alias("o"))
    pairs = got.select("c", "o", typed.reading_state(F.col("c"), F.col("o")).alias("s")).collect()
    plain = lambda r: tv.Reading(**r.asDict())
    assert len(pairs) > 100 and len({p.s for p in pairs}) == 3
    assert [p.s for p in pairs] == [sel.match(plain(p.c), plain(p.o)).replace("UNCLEAR", "UNKNOWN") for p in pairs]
