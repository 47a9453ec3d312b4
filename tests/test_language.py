"""Structure of documents, Korean query text, and typed values."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from evidra.functions import korean as kr
from evidra.functions import typed_values as tv
from evidra.operators import structure as st
from evidra.operators import typed

PAGE = "Overview\n\nSome plain words. And more.\nof them\r\nstill.\n\n| a | b |\n|---|---|\n| 1 | 2 |\n- item one\n3) item two\nName: value\nhttps://x.org/a\n====\nLast line of 30 days"


def _of(spark, build, texts):
    """The rows that build makes of each text, in order, by text."""
    out = [[] for _ in texts]
    for r in build(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id").collect():
        out[r.id].append(r)
    place = lambda r: tuple(r[c] for c in ("ordinal", "part", "passage") if c in r)
    return [sorted(rows, key=place) for rows in out]


def test_block_kinds_and_places(spark):
    found = _of(spark, st.blocks, [PAGE])[0]
    got = [(b.kind, b.first_line, b.last_line, b.parent) for b in found]
    assert got == [("HEADING", 1, 1, 1), ("PARAGRAPH", 3, 5, 1), ("TABLE_ROW", 7, 7, 1), ("OTHER", 8, 8, 1), ("TABLE_ROW", 9, 9, 1), ("LIST_ITEM", 10, 10, 1), ("LIST_ITEM", 11, 11, 1), ("KEY_VALUE", 12, 12, 1), ("PARAGRAPH", 13, 13, 1), ("OTHER", 14, 14, 1), ("PARAGRAPH", 15, 15, 1)]
    assert all(PAGE[b.start : b.end] == b.content for b in found)


def test_blocks_need_no_python(spark):
    plan = st.blocks(spark.createDataFrame([(1, PAGE)], "id int, text string"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_headings(spark):
    cases = {"Short title\nplain text follows here.": "HEADING", "Short title\nApril 2021": "PARAGRAPH", "This ends.\n\nx": "PARAGRAPH", "w " * 9 + "\nmore": "PARAGRAPH", "# Head\nx": "HEADING", "only": "HEADING", "a | b | c": "TABLE_ROW", "a\tb\tc": "TABLE_ROW", "x: y": "KEY_VALUE", "ftp://x:y": "PARAGRAPH", "===": "OTHER"}
    assert [b[0].kind for b in _of(spark, st.blocks, list(cases))] == list(cases.values())


def test_table_rows_carry_their_head(spark):
    tables = [PAGE, "| a | b |\n| 1 | 2 |\n\n| 3 | 4 |", "| a | b |\n|---|---|\n| 1 | 2 |\n|---|---|\n| 3 | 4 |", "| a | b |\n---\n| 1 | 2 |"]
    rows = [[c for c in kids if c.kind == "TABLE_ROW"] for kids in _of(spark, st.children, tables)]
    assert [(c.header, c.retrieval) for c in rows[0]] == [(0, "| a | b |"), (3, "| a | b |\n| 1 | 2 |")]
    assert [[c.header for c in r] for r in rows[1:]] == [[0, 1, 0], [0, 1, 3], [0, 0]]
    (found, *_), *_ = _of(spark, st.passages, ["| a | b |\n|---|---|\n| 1 | 2 |"])
    assert found.n_children == 2 and found.retrieval == "| a | b |\n| 1 | 2 |"  # the head is there already


def test_children_lose_no_ink_and_keep_to_the_bound(spark):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abc", k=rng.randint(1, 40))) + rng.choice(["", "", ".", "\r\n", "\n"]) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    ink = lambda spans: "".join("".join(s.content.split()) for s in spans)
    for text, blocks, kids, found in zip(texts, *(_of(spark, f, texts) for f in (st.blocks, st.children, st.passages)), strict=True):
        assert all(text[c.start : c.end] == c.content and 0 < len(c.retrieval) <= st.PASSAGE_MOST for c in kids)
        assert all((c.first_line, c.last_line) == (1 + text.count("\n", 0, c.start), 1 + text.count("\n", 0, c.end)) for c in kids)
        assert ink(kids) == ink(b for b in blocks if b.kind not in ("HEADING", "OTHER")) == ink(found)
        assert sum(p.n_children for p in found) == len(kids) and [p.passage for p in found] == list(range(1, len(found) + 1))
        assert all(len(p.retrieval) <= st.PASSAGE_MOST for p in found)


def test_passages_by_brute_force(spark):
    """Children one after the other, with the rules of growth on their own lengths."""
    rng = random.Random(7)
    texts = ["\n".join(rng.choice(["word " * rng.randint(1, 60) + "end.", f"- {'item ' * rng.randint(1, 30)}x", "", f"name: {'v' * rng.randint(1, 90)}"]) for _ in range(40)) for _ in range(20)]
    for kids, found in zip(_of(spark, st.children, texts), _of(spark, st.passages, texts), strict=True):
        want, size = [], 0
        for a, c in zip([None, *kids], kids, strict=False):
            grown = size + 1 + len(c.retrieval)
            touches = a is not None and a.parent == c.parent and c.first_line <= a.last_line + 2 and c.ordinal - a.ordinal in (0, 1)
            if touches and grown <= st.PASSAGE_MOST and (grown <= st.PASSAGE_TARGET or size < st.PASSAGE_LEAST):
                want[-1].append(c.retrieval)
                size = grown
            else:
                want.append([c.retrieval])
                size = len(c.retrieval)
        assert [p.retrieval for p in found] == ["\n".join(w) for w in want]


def test_heading_paths(spark):
    text = "# One\n## Two ##\n#### Four\n### Three\n# Next\n\nPlain title\n\n## After\n### Deep"
    long = "# " + "x" * 100 + "\n## " + "y" * 50 + "\n## " + "z" * 130
    found = _of(spark, st.heading_paths, [text, long, "no heading here, only text."])
    assert [r.path for r in found[0]] == ["One", "One > Two", "Two > Four", "Two > Three", "Next", "Plain title", "After", "After > Deep"]
    assert [list(r.path_blocks) for r in found[0]][1:4] == [[1, 2], [2, 3], [2, 4]]
    assert [r.path for r in found[1]] == ["x" * 100, "y" * 50, "z" * 120] and found[2] == []  # too long: without the upper part, then cut


def test_passages_carry_their_path(spark):
    rows = spark.createDataFrame([(7, "Line above all.\n\n# One\n## Two\n- item"), (7, "# Other\n- item"), (8, None)], "id int, text string")
    got = {(r.path, r.contextual) for r in st.contextual_passages(rows, "id").collect()}
    assert got == {(None, "Line above all."), ("One > Two", "One > Two\n- item"), ("Other", "Other\n- item")}


def test_structure_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "A title\n\nA line.", "x"), (3, "A title\n\nA line.", "x"), (4, f"| {'x' * 500} | b |\n| 1 | 2 |", "x")], "id long, text string, kind string")
    assert {r.id for r in st.passages(rows, "id").collect()} == {3, 4}
    assert [r.content for r in st.children(rows.where("id = 4"), "id").collect()][-1] == "| 1 | 2 |"  # without the head that leaves no room
    assert [tuple(r) for r in st.faults(rows, "id").collect()] == [(4, "a table's head row leaves no room for its rows")]
    assert st.blocks(rows.limit(0), "id").columns == ["id", "ordinal", "kind", "parent", "first_line", "last_line", "start", "end", "content"]
    assert st.blocks(rows.limit(0), "id").count() == 0


def test_korean():
    assert kr.stem_of("배포했나요") == "배포" and kr.stem_of("이가") == "이가"
    assert kr.identifiers_of("Redis를 Spring Boot에서 v2.0. kafka-streams로부터") == ["redis", "springboot", "v2.0"]
    assert kr.anchors_of("Redis를 활용한 경험") == ["redis"]
    assert kr.variants_of("Redis를 활용한 경험 알려줘") == ["Redis 활용 경험"]
    assert kr.variants_of("Kafka") == ["Kafka 경험"]
    assert kr.variants_of("웹 서버에서 파일을 제공한 경험") == ["웹 서버에서 파일을 직접 서빙한 경험", "웹 서버 파일 직접 서빙 경험"]
    assert kr.variants_of("plain words") == []
    assert kr.numeric_anchors_of("1,200건, 30% 12.50 퍼센트 3ms 3ms") == [("1200", "건"), ("30", "%"), ("12.5", "%"), ("3", "ms")]


def test_korean_columns(spark):
    r = spark.createDataFrame([("30% 3", "about 30퍼센트 5건"), ("3", "3"), (None, None)], "q string, c string").select(kr.numeric_anchors("q").alias("a"), kr.numeric_anchors("c").alias("b"), kr.stem("q").alias("s"), kr.needs_direct_anchor("q").alias("d"))
    got = r.select(kr.numbers_met(F.col("a"), F.col("b"), True).alias("every"), kr.numbers_met(F.col("a"), F.col("b"), False).alias("some"), "d").collect()
    assert [(x["every"], x["some"]) for x in got[:2]] == [(True, True), (False, False)]
    assert got[2].d is None


def _query(text):
    return [(r.kind, r.op, r.low, r.high, r.unit, r.name, r.qualifier, r.direction) for r in tv.read(text, tv.QUERY_RULES)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("on or after 2023-05", ("DATE", "GTE", "2023-05-01", "2023-05-31", "YEAR_MONTH", None, "", "NONE")),
        ("from 2020-01-01 to 2020-02-29", ("DATE", "RANGE", "2020-01-01", "2020-02-29", "FULL_DATE", None, "", "NONE")),
        ("2019~2021", ("DATE", "RANGE", "2019-01-01", "2021-12-31", "YEAR", None, "", "NONE")),
        ("응답 시간을 200ms 이하", ("QUANTITY", "LTE", "200", None, "ms", None, "응답 시간", "NONE")),
        ("reduced the memory usage by more than 25%", ("QUANTITY", "GT", "25", None, "%", None, "memory usage", "DECREASE")),
        ("30% reduction in latency", ("QUANTITY", "EQ", "30", None, "%", None, "latency", "DECREASE")),
        ("job run between 3 and 5 hours", ("QUANTITY", "RANGE", "3", "5", "hours", None, "job", "NONE")),
        ("exceeding 1,500 active users", ("QUANTITY", "GT", "1500", None, "count", None, "active users", "NONE")),
        ("Kafka 3.02", ("IDENTIFIER_NUMBER", "EQ", "3.2", None, None, "kafka", "", "NONE")),
        ('"Spring Boot"', ("LITERAL", "EQ", None, None, None, "springboot", "", "NONE")),
    ],
)
def test_constraints(text, want):
    assert _query(text) == [want]


@pytest.mark.parametrize("text", ["", "2024-13-01", "10k", "at least 5% 미만", "9~3%", "2021~2019"])
def test_no_constraint(text):
    assert _query(text) == []


def test_observations():
    text = "Latency decreased by 30% in spring. The job ran for 3 hours and served 500 users in Rome. Java 17 runs. 20~30%"
    got = [(r.kind, text[r.start : r.end], r.qualifier, r.direction) for r in tv.read(text, tv.DOCUMENT_RULES)]
    assert got == [("QUANTITY", "30%", "latency", "DECREASE"), ("QUANTITY", "3 hours", "job", "NONE"), ("QUANTITY", "500", "users", "NONE"), ("IDENTIFIER_NUMBER", "Java 17", "", "NONE")]


@pytest.mark.parametrize(
    ("query", "document", "state"),
    [
        ("reduce latency by at least 20%", "mean latency reduced by 30%", "SATISFIED"),
        ("Kafka 3.2", "on Kafka 2.8", "CONTRADICTED"),
        ("Kafka 3.2", "on Redis 7", "UNKNOWN"),
        ("reduce the cost by 20%", "cost increased by 20%", "CONTRADICTED"),
        ("since 2021-05", "since 2021-05-03", "SATISFIED"),
        ("since 2021-05-03", "since 2021-05", "UNKNOWN"),
    ],
)
def test_states(spark, query, document, state):
    row = spark.createDataFrame([(query, document)], "q string, d string")
    pair = row.select(tv.constraints("q")[0].alias("c"), tv.observations("d")[0].alias("o"))
    assert pair.select(typed.reading_state(F.col("c"), F.col("o")).alias("s")).first().s == state


def test_rules_pass_over_plain_words():
    text = "plain words of no capital that lasted over there, "
    tried = [m for p, _, *needs in tv.QUERY_RULES + tv.DOCUMENT_RULES if not needs or needs[0].search(text) for m in p.finditer(text)]
    assert not tried and not tv.read(text, tv.QUERY_RULES)


def test_bare_literals_are_those_of_all_words():
    words = regex.compile(r"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9]*(?:[-_.][A-Za-z0-9]+)*(?![A-Za-z0-9_])")
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choices("abAB1-_. é", k=rng.randint(1, 14)))
        got, want = ([m.span() for m in p.finditer(text) if tv._bare(text, m)] for p in (tv.QUERY_RULES[-1][0], words))
        assert got == want, text
