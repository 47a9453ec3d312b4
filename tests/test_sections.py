"""Section-aware chunks and literal anchors."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from evidra.functions import literals as li
from evidra.operators import sections as se


def _cut(spark, texts, chunks=se.section_chunks):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = {k: [] for k in range(len(texts))}
    for r in chunks(rows, "id").orderBy("id", "chunk_no").collect():
        out[r.id].append(r.content)
        assert r.chunk_no == len(out[r.id])
    return [out[k] for k in range(len(texts))]


LINE = "word " * 39 + "end."  # 199 characters


def test_sections(spark):
    got = _cut(spark, [f"Heading only\n01 First\n{LINE}", f"01 A\n{LINE}\r\n02 B\r{LINE}\n결과", "\n".join([LINE] * 3), " \n ", "only heads", None, "x" * 700 + "\ny"])
    assert got == [[f"Heading only\n01 First\n{LINE}"], [f"01 A\n{LINE}", f"02 B\n{LINE}\n결과"], ["\n".join([LINE] * 3)], [], ["only heads"], [], ["x" * 700, "y"]]


def test_short_tails_take_lines(spark):
    """The tail takes the fewest lines that make it long enough, if the chunk before keeps its least and the bound holds."""
    words = lambda n: "w" * n
    got = _cut(spark, ["\n".join(map(words, (200, 100, 100, 100, 150))), "\n".join(map(words, (120, 390, 195))), "\n".join(map(words, (240, 270, 100)))])
    assert [[len(c) for c in g] for g in got] == [[402, 251], [511, 195], [511, 100]]


def test_sections_keep_all_lines_and_bounds(spark):
    rng = random.Random(2)
    texts = ["\n".join("".join(rng.choices("abc .", k=rng.randint(1, 200))) for _ in range(rng.randint(1, 30))) for _ in range(100)]
    for text, got in zip(texts, _cut(spark, texts), strict=True):
        assert "\n".join(got).split("\n") == [s for x in text.split("\n") if (s := x.strip())]
        assert all(len(c) <= se.EVENED_MOST for c in got)


def test_cases_carry_their_parent(spark):
    parent, case = "01 Project", "Case {} " + "word " * 30 + "end."
    one, two = case.format(1), case.format(2)
    long = "Case 3 " + "word " * 118 + "end."
    got = _cut(spark, [f"{parent} done.\n{one}\n{two}", f"{parent} done.\n{one}\n{long}", f"{one}\n{parent} done.\nplain", f"{LINE}\n{one}", f"{parent}\n{one}"], se.case_chunks)
    assert got[0] == [f"{parent} done.\n{one}", f"{parent} done.\n{two}"]
    assert got[1] == [f"{parent} done.", one, long]  # one case would be too long: none is changed
    assert got[2] == [one, f"{parent} done.\nplain"] and got[3] == [LINE, one]
    assert got[4] == [f"{parent}\n{one}"]  # a heading without a sentence is the case's own already


def test_section_chunks_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a\nb", 0), (3, "a\nb", 0), (None, "c", 0)], "id long, text string, chunk_no int")
    assert sorted(map(str, se.section_chunks(rows, "id").collect())) == sorted(map(str, [Row(id=3, chunk_no=1, content="a\nb")] * 2 + [Row(id=None, chunk_no=1, content="c")]))
    assert se.case_chunks(rows.limit(0), "id").count() == 0


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("응답 1,200건 처리", [("1,200건", "NUMERIC_UNIT")]),
        ("Spring Boot 3.2 migration으로", [("Spring Boot 3.2 migration", "MULTI_TOKEN_IDENTIFIER")]),
        ("JPA와 OAuth2를", [("JPA", "IDENTIFIER"), ("OAuth2", "IDENTIFIER")]),
        ("10/20/30 결과", [("10/20/30", "CODE_IDENTIFIER")]),
        ("API와 plain", []),
        ("", []),
    ],
)
def test_literal_anchors(query, want):
    assert [(v, k) for v, _, k in li.literal_anchors_of(query)] == want


def test_all_held(spark):
    rows = spark.createDataFrame([("JPA를 30%", "JPA — 30% up"), ("JPA", None), ("plain", None), (None, "x")], "q string, t string")
    read = rows.select(li.literal_anchors("q").alias("a"), li.form("t").alias("f"))
    got = read.select(li.all_held(F.col("a"), F.col("f")).alias("h")).collect()
    assert [r.h for r in got] == [True, False, True, None]
    assert li.literal_form("A – b, C!") == "a-b c"
    assert rows.select(li.all_held(F.array().cast("array<struct<value:string,form:string,kind:string>>"), F.col("t")).alias("h")).first().h
