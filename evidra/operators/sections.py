"""Section-aware chunks: lines packed inside sections, headings without prose joined to what follows, short tails evened out.

Lines are rows. A section's number is the count of section lines so far; a short section without a sentence goes to the
next other one (the last ones to the one before). Within such a home lines are packed by a fold over their lengths, and a
short tail takes lines of the chunk before it: its cut is chosen at once from the lengths of all suffixes. A line is
never cut, so a chunk is longer than the bound only if one of its lines is. Null and blank texts have no chunks; rows
that repeat a key are texts of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lengths in characters, and the lines that begin a section or a case.
CHUNK_MOST, EVENED_MOST, TAIL_LEAST, PREVIOUS_LEAST, CONTEXT_MOST = 520, 600, 200, 250, 160
SECTION = r"(?:0[1-9]|[1-9][0-9]?)\s+\S.*|(?:문제 원인|해결 과정|성능 측정 결과|결과|기술 스택|프로젝트 경험|대표 문제 해결 사례|수상|활동)(?:\s+.*)?|Project Portfolio.*|Case\s+[0-9]+.*|.{1,80}\s[—-]\s.{1,80}"
CASE = r"^Case\s+[0-9]+"
SENTENCE_END = ".!?。"
BLANK = r"[\t-\r\x1c-\x1f   -  -    　]+"


def _homes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(row, key, home, lines): the lines of each home, sorted, with their lengths n and running sums of n + 1."""
    said = F.split(F.col(text), "\r\n|\r|\n")
    texts = rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), said.alias("said"))
    lines = texts.select("row", "key", F.posexplode("said").alias("i", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", f"^{BLANK}|{BLANK}$", "")).where("line <> ''").withColumn("n", F.char_length("line"))
    order = Window.partitionBy("row").orderBy("i")
    lines = lines.withColumn("section", F.count(F.when(F.col("line").rlike(f"^(?:{SECTION})$"), 1)).over(order))
    whole = Window.partitionBy("row", "section")
    prose = F.max(F.col("line").rlike(f"[{SENTENCE_END}]$")).over(whole)
    own = F.when(prose | (F.sum("n").over(whole) + F.count("*").over(whole) - 1 > CONTEXT_MOST), F.col("section"))
    following = F.min("own").over(order.rowsBetween(0, Window.unboundedFollowing))
    before = F.max("own").over(order.rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("own", own).withColumn("home", F.coalesce(following, before, F.lit(0)))
    total = F.sum(F.col("n") + 1).over(Window.partitionBy("row", "home").orderBy("i"))
    lines = lines.select("row", "key", "home", F.struct("i", "n", total.alias("sum"), "line").alias("x"))
    return lines.groupBy("row", "key", "home").agg(F.sort_array(F.collect_list("x")).alias("lines"))


def _cuts(lines: Column) -> Column:
    """Where chunks begin: each takes lines as long as it stays within the bound."""
    start = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("k"))

    def step(acc: Column, x: Column) -> Column:
        new = (F.size(acc["cuts"]) == 0) | (x["sum"] - acc["sum"] - 1 > CHUNK_MOST)
        cuts = F.when(new, F.array_append(acc["cuts"], acc["k"])).otherwise(acc["cuts"])
        return F.struct(cuts.alias("cuts"), F.when(new, x["sum"] - x["n"] - 1).otherwise(acc["sum"]).alias("sum"), (acc["k"] + 1).alias("k"))

    return F.aggregate(lines, start, step)["cuts"]


def _evened(lines: Column, cuts: Column) -> Column:
    """cuts with the last one gone or moved where the last chunk is short."""
    m = F.size(lines)
    length = lambda p, q: F.element_at(lines, q)["sum"] - F.element_at(lines, p + 1)["sum"] + F.element_at(lines, p + 1)["n"]  # noqa: E731  of lines p to q - 1
    before, tail = F.element_at(cuts, -2), F.element_at(cuts, -1)
    may = lambda p: (p == tail) | ((length(before, p) >= PREVIOUS_LEAST) & (length(p, m) <= EVENED_MOST))
    places = F.filter(F.sequence(before + 1, tail), may)
    moved = F.coalesce(F.array_max(F.filter(places, lambda p: length(p, m) >= TAIL_LEAST)), F.array_min(places))
    head = F.slice(cuts, 1, F.size(cuts) - 1)
    fixed = F.when(length(before, m) <= EVENED_MOST, head).otherwise(F.array_append(head, moved))
    return F.when((F.size(cuts) > 1) & (length(tail, m) < TAIL_LEAST), fixed).otherwise(cuts)


def _chunks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(row, key, chunk_no, content)"""
    homes = _homes(rows, key, text).withColumn("cuts", _cuts(F.col("lines"))).withColumn("cuts", _evened(F.col("lines"), F.col("cuts")))
    cut = homes.select("row", "key", "home", "lines", F.posexplode("cuts").alias("k", "at"), F.expr("array_append(slice(cuts, 2, size(cuts)), size(lines))").alias("ends"))
    part = F.slice("lines", F.col("at") + 1, F.element_at("ends", F.col("k") + 1) - F.col("at"))
    cut = cut.select("row", "key", "home", "k", F.array_join(F.transform(part, lambda x: x["line"]), "\n").alias("content"))
    return cut.select("row", "key", F.row_number().over(Window.partitionBy("row").orderBy("home", "k")).alias("chunk_no"), "content")


def section_chunks(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, chunk_no, content), chunks numbered from 1."""
    return _chunks(rows, key, text).select(F.col("key").alias(key), "chunk_no", "content")


def case_chunks(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, chunk_no, content): section chunks in which a short chunk before cases goes in front of each of them, if none
    grows beyond the bound; cases are never merged."""
    chunks = _chunks(rows, key, text)
    case = F.col("content").rlike(CASE)
    chunks = chunks.withColumn("case", case).withColumn("run", F.count(F.when(~case, 1)).over(Window.partitionBy("row").orderBy("chunk_no")))
    run = Window.partitionBy("row", "run")
    parent = F.max(F.when(~F.col("case"), F.col("content"))).over(run)  # the first of its run, if it is no case
    longest = F.max(F.when(F.col("case"), F.char_length("content"))).over(run)
    chunks = chunks.withColumn("parent", parent).withColumn("longest", longest)
    short = (F.char_length("parent") <= CONTEXT_MOST) & ~F.col("parent").rlike(f"(?m){CASE}")
    carried = F.coalesce(short & (F.char_length("parent") + 1 + F.col("longest") <= EVENED_MOST), F.lit(False))
    chunks = chunks.where(F.col("case") | ~carried).withColumn("content", F.when(carried, F.concat_ws("\n", "parent", "content")).otherwise(F.col("content")))
    return chunks.select(F.col("key").alias(key), F.row_number().over(Window.partitionBy("row").orderBy("chunk_no")).alias("chunk_no"), "content")
