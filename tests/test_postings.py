"""Job postings: sections, blocks, lists, sentences, limits; planned searches and the merge of their results."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidra.functions import posting_lines as pl
from evidra.operators import job_evidence as je
from evidra.operators import postings as po

CASES = {
    "marks": ("- 결제 화면\n* 캐시 서버\n•큐 서버\n3) Batch jobs\n-코틀린\n---\n- - nested", [(None, t) for t in ("결제 화면", "캐시 서버", "큐 서버", "Batch jobs", "코틀린", "nested")]),
    "unknown": ("- 결제 API 개발 경험\n- 큐 운영 경험\n- 결제 화면", [(None, "결제 API 개발 경험"), (None, "큐 운영 경험")]),
    "sections": ("담당업무\n• 서버 개발\n자격요건\n- 자바 경험\n복지\n- 무료 점심\n우대사항:\n- 쿠버네티스 경험", [("담당업무", "서버 개발"), ("자격요건", "자바 경험"), ("우대사항", "쿠버네티스 경험")]),
    "groups": ("## Responsibilities\n• Platform\n  - Own pipelines\n  - Test pipelines\n• Review code\n", [("Platform", "Own pipelines"), ("Platform", "Test pipelines"), ("Responsibilities", "Review code")]),
    "sentences": ('We ship. They say "done." Then v1.2 goes out!\n\nWe ship.', [(None, "We ship."), (None, 'They say "done."'), (None, "Then v1.2 goes out!")]),
    "excluded": ("About us\nWe are big\nRequirements\nExperience with Go\nCompensation\n$100,000 - $120,000 annually\nPay is good", [("Requirements", "Experience with Go")]),
    "form": ("Requirements\n- Experience with SQL\nSubmit your application\nFirst name\nLast name\nPhone\nLinkedIn", [("Requirements", "Experience with SQL")]),
    "metadata": ("[Backend]\n자격요건\n- 5년 개발 경험\n정규직\n3명 모집\n서류전형\n10:00 ~ 19:00", [("자격요건", "5년 개발 경험")]),
    "inline": ("Position\nRequired skills: experience with Rust\nOther: none", [("Position", "Required skills: experience with Rust"), ("Position", "Other: none")]),
    "markup": ("| **Requirements** |\n:---:\n| - Build APIs<br/>for users |\\\n", [("Requirements", "Build APIs for users")]),
    "again": ("Requirements\n- Build APIs\n- Build  APIs\n- !\n- x", [("Requirements", "Build APIs")]),
    "subheads": ("Requirements\nData work\nBuild pipelines well\nExperience with Spark\n", [("Data work", "Build pipelines well"), ("Data work", "Experience with Spark")]),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(k, t) for k, (t, _) in CASES.items()] + [("null", None), ("empty", ""), ("many", "\n".join(f"- item no {k}" for k in range(101))), ("hundred", "\n".join(f"- item no {k}" for k in range(100))), ("long", "- " + "word " * 120), ("hard", "- a" + "!" * 700 + "b")]
    out = {}
    for r in po.segments(spark.createDataFrame(rows, "posting_id string, text string")).collect():
        out.setdefault(r.posting_id, []).append(r)
    return {k: sorted(v, key=lambda r: r.item_id or 0) for k, v in out.items()}


@pytest.mark.parametrize("name", CASES)
def test_segments(found, name):
    assert [(r.section, r.text) for r in found[name]] == CASES[name][1]
    assert [r.item_id for r in found[name]] == list(range(1, len(found[name]) + 1))


def test_limits_give_rows(found):
    assert "null" not in found and "empty" not in found
    assert [tuple(r) for r in found["many"]] == [("many", None, None, None, "TOO_MANY_ITEMS")]
    assert len(found["hundred"]) == 100 and found["hard"][0].fault == "ITEM_TOO_LONG"
    assert " ".join(r.text for r in found["long"]) == ("word " * 120).strip() and len(found["long"]) == 2


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab1 ,.;:!😀é"), max_size=120), st.integers(4, 30))
def test_pieces(text, limit):
    """Pieces keep all but blanks, fit, hold two letters or digits each, and cut no character in two."""
    text = " ".join(text.split())
    got = po.pieces(text, limit)
    if got is not None:
        assert "".join(got).replace(" ", "") == text.replace(" ", "")
        assert all(len(p.encode("utf-16-be")) <= 2 * limit for p in got)
        assert len(got) < 2 or all(sum(c.isalnum() for c in p) >= 2 for p in got)


def test_line_marks(spark):
    raw = ["# Head", "► Context", "  - **Bold**", "1) one", "-- x", "a - b", "・no", "•• y"]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(raw)], "k int, raw string")
    rows = rows.withColumn("plain", pl.bare(pl.flat(F.col("raw")))).withColumn("item", pl.without_bullets(F.col("plain")))
    got = rows.select("k", pl.parsed(F.col("raw"), F.col("plain"), F.col("item")).alias("p")).select("k", "p.*").orderBy("k").collect()
    assert [(r.text, r.level, r.heading, r.context, r.grouping) for r in got] == [
        ("Head", 0, True, False, False), ("Context", 0, True, True, False), ("Bold", 3, False, False, False), ("one", 1, False, False, False),
        ("-- x", 0, False, False, False), ("a - b", 0, False, False, False), ("・no", 0, False, False, False), ("y", 1, False, False, True),
    ]


PLANS = {
    "Java or Kotlin": ["Java", "Kotlin"],
    "Java, Go, Rust 중 2개 이상 사용": ["Java", "Go", "Rust"],
    "MySQL, Redis 등의 저장소 운영": ["MySQL", "Redis"],
    "MySQL/Redis 등 운영": ["MySQL", "Redis"],
    "1,000 건, 처리 중 하나 이상": [],
    "AWS, GCP 또는 Azure 경험": ["AWS", "GCP", "Azure 경험"],
    "a long list of words, GCP or Azure": [],
    "AWS / GCP": ["AWS", "GCP"],
    "AWS/GCP": [],
    "AWS/GCP/Azure": ["AWS", "GCP", "Azure"],
    "src/main/Java": [],
    "https://a.b/c/d": [],
    "C or R": ["C", "R"],
    "Go or go or GO or Go or go": ["Go"],
    "aa or bb or cc or dd or ee or ff": ["aa", "bb", "cc", "dd", "ee"],
    "plain text": [],
}


def test_plan(spark):
    texts = list(PLANS)
    got = {}
    for r in je.plan(spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, None)], "item_id int, text string")).orderBy("item_id", "query_no").collect():
        got.setdefault(r.item_id, []).append(r)
    assert 99 not in got
    for k, t in enumerate(texts):
        assert [r.query for r in got[k]] == [t, *PLANS[t]] and [r.original for r in got[k]] == [True] + [False] * len(PLANS[t])
    assert [r.direct for r in got[0]] == [False, True, True] and [r.direct for r in got[5]] == [False, True, True, False]


def test_merge_by_brute_force(spark):
    """First five candidates in the order of the searches; names must be held between characters that are no part of names."""
    rng = random.Random(1)
    items = [(1, "c++ or .NET"), (2, "redis"), (3, "some words"), (4, "x or y or z")]
    planned = je.plan(spark.createDataFrame(items, "item_id int, text string"))
    sets = je.result_sets(planned).orderBy("item_id", "set_no").collect()
    says = ["we use C++.", "we use C++ daily", "(.NET)", "a.NET", "redis-cluster", "Redis", "redis", "none", "x", "y z"]
    searches = sorted({(r.item_id, r.query_no) for r in sets})
    results = [(i, q, doc, rank, says[doc]) for i, q in searches for rank, doc in enumerate(rng.sample(range(10), 6), 1)]
    got = je.merge(je.result_sets(planned), spark.createDataFrame(results, "item_id int, query_no int, chunk int, rank int, content string"), ["chunk"]).collect()

    def held(name, text):
        at, name, text = -1, name.lower(), text.lower()
        part = set("abcdefghijklmnopqrstuvwxyz0123456789+#._-")
        while (at := text.find(name, at + 1)) >= 0:
            if (not at or text[at - 1] not in part) and (at + len(name) == len(text) or text[at + len(name)] not in part):
                return True
        return False

    want = set()
    for item, _ in items:
        merged = {}
        for s in [s for s in sets if s.item_id == item]:
            for _, _, doc, _, text in sorted((r for r in results if r[:2] == (item, s.query_no)), key=lambda r: r[3]):
                if s.direct and not held(s.query, text):
                    continue
                if doc not in merged and len(merged) < 5:
                    merged[doc] = {"queries": [], "shown": s.query, "by": s.direct}
                if doc in merged:
                    m = merged[doc]
                    m["queries"] += [] if s.query in m["queries"] else [s.query]
                    if s.direct and not m["by"]:
                        m["shown"], m["by"] = s.query, True
        want |= {(item, doc, k, tuple(m["queries"]), m["shown"], m["by"]) for k, (doc, m) in enumerate(merged.items(), 1)}
    assert {(r.item_id, r.chunk, r.pos, tuple(r.queries), r.shown, r.by_name) for r in got} == want


@pytest.mark.parametrize("name", ["job_query_plan", "presentation_highlights"])
def test_texts_of_one_or_two_words_ask_nothing(spark, tmp_path, name):
    """A filter may be read after what stands behind it: no word is taken by a number that a short text does not have."""
    from evidra.plans import postings, results  # noqa: F401  register their queries
    from evidra.plans import queries as plans

    rows = [(50, "one"), (100, "two words"), (151, ""), (200, None), (251, "alpha beta gamma"), (300, "delta beta gamma")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("web")}).write.parquet(str(tmp_path / "documents.parquet"))
    got = plans.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.item_id for r in got} == {300} if name == "job_query_plan" else {r.chunk_id for r in got} == {251_000_001, 300_000_001}


def test_no_line_is_parsed_for_a_filter(spark):
    """What leaves out blank lines is no filter that is pushed below the parse, which would then be made twice and more."""
    plan = po.lines(spark.createDataFrame([(1, "a\n\nb")], "posting_id long, text string"), "posting_id", "text")
    filters = [x for x in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
    assert not any("regexp_replace" in x.lower() for x in filters)
    assert [(r.line, r.text) for r in plan.collect()] == [(0, "a"), (2, "b")]


def test_stems_held_by_a_column_are_those_of_the_pattern(spark):
    words = ["", "none", "skills", "myskillset", "업무내용", "aboutus", "quali", "qualification", None]
    rows = spark.createDataFrame([(w,) for w in words], "c string")
    stems = (*pl.SEARCHABLE, *pl.INTRO)
    assert all(r[0] == r[1] for r in rows.select(pl.has(F.col("c"), stems), pl.holds_any(F.col("c"), stems)).collect())


def test_lines_are_sorted_once(spark):
    """Stretches between two signs are told by numbers of lines: all windows have one order, and no line carries its next ten."""
    rows = po.sectioned(po.blocked(po.ahead_of(po.headed(po.lines(spark.createDataFrame([(1, "a\n\nb")], "posting_id long, text string"), "posting_id", "text")))))
    plan = [x.strip(" +-:*()0123456789") for x in rows._jdf.queryExecution().executedPlan().toString().splitlines()]
    assert sum(x.startswith("Sort [") for x in plan) == 1 and not any("collect_list" in x for x in plan)


def test_stems_of_all_groups_are_held_as_by_each(spark):
    stems = sorted({s for group in pl.GROUPS.values() for s in group})
    rows = spark.createDataFrame([(w,) for w in ["", "none", *stems, *(f"x{s}y" for s in stems), *(s[:-1] for s in stems)]], "c string")
    each = F.struct(*[pl.holds_any(F.col("c"), group).alias(name) for name, group in pl.GROUPS.items()])
    assert all(r.a == r.b for r in rows.select(pl.held("c").alias("a"), each.alias("b")).collect())


def test_untouched_lines_are_flat_as_the_rest(spark):
    """What is told apart for speed changes no text: each line is as it is behind a mark that goes."""
    lines = ["", " ", "a", " a", "a ", "a  b", "a\tb", "a b", "a　b", "a b", "# a", "a # b", "a<br/>b", "a < b", " a", "·a", "a​b"]
    rows = spark.createDataFrame([(w,) for w in lines], "t string")
    assert all(r[0] == r[1] for r in rows.select(pl.flat(F.col("t")), pl.flat(F.concat("t", F.lit("\\")))).collect())
