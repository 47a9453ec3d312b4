"""Structure of documents: blocks of lines, evidence children inside them, retrieval passages over those.

Lines, blocks and children are rows; what their neighbours say is read by windows within a document: a heading by the lines
around it, a block by the run of its lines, its parent by the last heading, a table's head by the last row that began a
table. Only blocks that are too long are cut in Arrow, one block at a time. Passages are a fold over the lengths of touching
children. A null or empty text gives no rows; rows that repeat a key are documents of their own. Offsets are code points.
"""

from __future__ import annotations


import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.unicode import manifest_digest
from ..sources.work import stored

# Layout patterns, their precedence, and bounds in code points.
OTHER = r"[-=_]{3,}|[─━]{3,}"
DIVIDER = r"\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*"
MARKDOWN_HEADING = r"#{1,6}\s+\S.*"
LIST_ITEM = r"(?:[-*+•▪◦]|(?:[0-9]+|[A-Za-z])[.)])\s+\S.*"
KEY_VALUE = r"[^:：\n]{1,40}[:：]\s*\S.*"
URI = r"[A-Za-z][A-Za-z0-9+.-]*://\S+"
ASSERTION = r"(?<![0-9])(?:19|20)[0-9]{2}(?:[./-][0-9]{1,2}(?:[./-][0-9]{1,2})?)?(?![0-9])|[0-9][0-9,.]*\s*(?:%|[a-z]{2}|[A-Z]{2}|[가-힣])|\s[—–]\s*\S"
TERMINAL = "[.!?。！？;；:]$"
SENTENCE_END = re.compile(r"[.!?。！？](?=\s|$)", re.A)
HEADING_MAX, HEADING_TOKENS, VALUE_ROW_MAX, VALUE_ROW_TOKENS = 80, 8, 48, 6
PASSAGE_LEAST, PASSAGE_TARGET, PASSAGE_MOST = 120, 320, 480
# White space to strip: tabs and line ends, separators, Unicode spaces but those that forbid a break.
SPACE = "\t\n\v\f\r\x1c\x1d\x1e\x1f               　"
_EDGES = f"^[{SPACE}]+|[{SPACE}]+$"
_INK = re.compile(f"[^{SPACE}]")
_SHOWN = ["ordinal", "kind", "parent", "first_line", "last_line", "start", "end"]


def _whole(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?d)^(?:{pattern})$")


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def unix(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def own_kind(s: Column) -> Column:
    """A stripped line's kind by itself; PLAIN may still be a heading, by the lines around it."""
    return (
        F.when(s == "", "BLANK")
        .when(_whole(s, OTHER) | _whole(s, DIVIDER), "OTHER")
        .when(_whole(s, MARKDOWN_HEADING), "HEADING")
        .when(_whole(s, LIST_ITEM), "LIST_ITEM")
        .when((_count(s, "|") >= 2) | (_count(s, "\t") >= 2), "TABLE_ROW")
        .when(_whole(s, URI), "PARAGRAPH")
        .when(_whole(s, KEY_VALUE), "KEY_VALUE")
        .when(s.rlike(ASSERTION), "PARAGRAPH")
        .otherwise("PLAIN")
    )


def heads(before: Column, line: Column, after: Column) -> Column:
    """Whether a plain line between two (empty ones at the edges) is a heading."""
    words = lambda x: F.size(F.split(x, r"\s+"))
    value_row = (F.length(after) <= VALUE_ROW_MAX) & (words(after) <= VALUE_ROW_TOKENS) & ~after.rlike(TERMINAL) & after.rlike(ASSERTION)
    return (before == "") & (F.length(line) <= HEADING_MAX) & ~line.rlike(TERMINAL) & ((after == "") | (~value_row & (words(line) <= HEADING_TOKENS)))


def _in(order: str, *parts: str) -> WindowSpec:
    return Window.partitionBy("_row", *parts).orderBy(order)


def _lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(_row, key, line, raw, body, start, kind) of every line."""
    numbered = rows.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("parts"))
    lines = numbered.select("_row", "_key", F.posexplode("parts").alias("at", "raw")).withColumn("line", F.col("at") + 1)
    before = _in("line").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("start", F.coalesce(F.sum(F.length("raw") + 1).over(before), F.lit(0)).cast("long"))
    lines = lines.withColumn("body", F.regexp_replace("raw", r"\r\z", "")).withColumn("bare", F.regexp_replace("body", _EDGES, "")).withColumn("own", own_kind(F.col("bare")))
    near = lambda f: F.coalesce(f("bare").over(_in("line")), F.lit(""))
    lines = lines.withColumn("above", near(F.lag)).withColumn("below", near(F.lead))
    kind = F.when(F.col("own") != "PLAIN", F.col("own")).when(heads(F.col("above"), F.col("bare"), F.col("below")), "HEADING").otherwise("PARAGRAPH")
    return lines.select("_row", "_key", "line", "raw", "body", "start", kind.alias("kind"))


def _blocks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(_row, _key, ordinal, kind, parent, lines, offsets, content): lines of a kind each; paragraph lines that touch are one block."""
    lines = _lines(rows, key, text)
    new = (F.col("kind") != "BLANK") & ~((F.col("kind") == "PARAGRAPH") & (F.coalesce(F.lag("kind").over(_in("line")), F.lit("")) == "PARAGRAPH"))
    lines = lines.withColumn("ordinal", F.sum(new.cast("int")).over(_in("line")).cast("int")).where("kind <> 'BLANK'")
    said = F.sort_array(F.collect_list(F.struct("line", "raw", "body")))
    blocks = lines.groupBy("_row", "_key", "ordinal").agg(F.min("kind").alias("kind"), F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.min("start").alias("start"), said.alias("said"))
    head = F.transform(F.slice("said", 1, F.size("said") - 1), lambda x: x["raw"])
    content = F.concat_ws("\n", F.concat(head, F.array(F.element_at("said", -1)["body"])))
    blocks = blocks.withColumn("content", content).withColumn("end", F.col("start") + F.length("content"))
    parent = F.coalesce(F.max(F.when(F.col("kind") == "HEADING", F.col("ordinal"))).over(_in("ordinal")), F.lit(0))
    return blocks.withColumn("parent", parent).drop("said")


def blocks(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ordinal, kind, parent, lines, offsets, content) of each block."""
    return _blocks(rows, key, text).select(F.col("_key").alias(key), *_SHOWN, "content")


# Children


def _pieces(text: str, room: int) -> Iterator[tuple[int, int]]:
    """Pieces of at most `room` code points: to the last end of a sentence, else of a line, else to the bound."""
    start = 0
    while (found := _INK.search(text, start)) is not None:
        start = found.start()
        hard = end = min(len(text), start + room)
        if hard < len(text):
            ends = [m.end() for m in SENTENCE_END.finditer(text, start, hard)]
            line = text.rfind("\n", start + 1, hard)
            end = ends[-1] if ends else line if line > start else hard
        end = start + len(text[start:end].rstrip(SPACE))
        yield start, end
        start = end


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())])))
def _cuts(text: pd.Series, room: pd.Series) -> pd.Series:
    """Where a long block is cut; a CRLF counts as one code point towards the bound and two of the text. Null for null."""

    def one(t: str, n: int) -> list[dict]:
        wide = [m.start() - k for k, m in enumerate(re.finditer("\r\n", t))]
        return [{"i": i + bisect_left(wide, i), "j": j + bisect_left(wide, j)} for i, j in _pieces(t.replace("\r\n", "\n"), n)]

    return pd.Series([None if t is None else one(t, int(n)) for t, n in zip(text, room, strict=True)])


def _children(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks but headings and rules, cut to the bound, with header (the ordinal of the row that heads a table's row, 0 without
    one), context (its text) and tight (the head leaves no room: the row stands without it)."""
    b, w = _blocks(rows, key, text), _in("ordinal")
    before = F.lag(F.struct("kind", "last_line", "parent", "content", "ordinal")).over(w)
    b = b.withColumn("before", before).withColumn("joined", F.coalesce((F.col("before.last_line") + 1 == F.col("first_line")) & (F.col("before.parent") == F.col("parent")), F.lit(False)))
    is_row, is_rule = F.col("kind") == "TABLE_ROW", F.col("kind") == "OTHER"
    after_row = F.col("joined") & (F.col("before.kind") == "TABLE_ROW")
    b = b.withColumn("ruled", is_rule & after_row & _whole(F.col("content"), DIVIDER))  # a rule below a row: the row is the head
    goes_on = is_row & (after_row | (F.col("joined") & F.coalesce(F.lag("ruled").over(w), F.lit(False))))
    row = lambda o, c: F.struct(o.alias("ordinal"), c.alias("content"))
    head = F.when(goes_on, F.lit(None)).when(is_row, row(F.col("ordinal"), F.col("content"))).when(F.col("ruled"), row(F.col("before.ordinal"), F.col("before.content"))).otherwise(row(F.lit(None).cast("int"), F.lit(None).cast("string")))
    b = b.withColumn("head", F.last(head, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("kind not in ('HEADING', 'OTHER')")
    b = b.withColumn("context", F.when(F.col("head.ordinal").isNotNull() & (F.col("head.ordinal") != F.col("ordinal")), unix(F.col("head.content"))))
    b = b.withColumn("tight", F.coalesce(F.length("context") + 1 >= PASSAGE_MOST, F.lit(False))).withColumn("context", F.when(~F.col("tight"), F.col("context")))
    b = b.withColumn("room", F.lit(PASSAGE_MOST) - F.coalesce(F.length("context") + 1, F.lit(0))).withColumn("header", F.when(F.col("context").isNotNull(), F.col("head.ordinal")).otherwise(0))
    long = F.length(F.replace("content", F.lit("\r\n"), F.lit("\n"))) > F.col("room")
    b = b.withColumn("cuts", _cuts(F.when(long, F.col("content")), F.col("room")))
    b = b.withColumn("cuts", F.coalesce("cuts", F.array(F.struct(F.lit(0).alias("i"), F.length("content").alias("j")))))
    c = b.select("_row", "_key", "ordinal", "kind", "parent", "header", "context", "tight", F.col("first_line").alias("l"), F.col("start").alias("s"), F.col("content").alias("t"), F.posexplode("cuts").alias("p", "cut"))
    c = c.withColumn("content", F.substring("t", F.col("cut.i") + 1, F.col("cut.j") - F.col("cut.i")))
    first = F.col("l") + _count(F.substring("t", F.lit(1), F.col("cut.i")), "\n")
    c = c.withColumn("first_line", first.cast("int")).withColumn("last_line", (F.col("first_line") + _count(F.col("content"), "\n")).cast("int"))
    c = c.withColumn("start", F.col("s") + F.col("cut.i")).withColumn("end", F.col("s") + F.col("cut.j")).withColumn("part", F.col("p") + 1)
    own = unix(F.col("content"))
    c = c.withColumn("own", own).withColumn("retrieval", F.when(F.col("header") > 0, F.concat_ws("\n", "context", own)).otherwise(own))
    return c.select("_row", "_key", *_SHOWN, "part", "header", "tight", "content", "own", "retrieval")


def children(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ordinal, part, kind, parent, header, lines, offsets, content, retrieval) of each child; rows of a table whose head leaves them no room stand without it."""
    return _children(rows, key, text).select(F.col("_key").alias(key), "ordinal", "part", "kind", "parent", "header", "first_line", "last_line", "start", "end", "content", "retrieval")


def faults(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, fault) of documents with rows that their table's head leaves no room."""
    tight = _children(rows, key, text).where("tight").groupBy("_row", "_key").agg(F.lit("a table's head row leaves no room for its rows").alias("fault"))
    return tight.select(F.col("_key").alias(key), "fault")


# Passages


def _starts(kids: Column) -> Column:
    """Where passages begin in a run of touching children (ordinal, header, own and whole lengths)."""
    empty = F.array().cast("array<int>")
    begin = F.struct(empty.alias("cuts"), F.lit(0).alias("size"), empty.alias("seen"), F.lit(0).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        grown = acc["size"] + 1 + F.when(F.array_contains(acc["seen"], c["header"]), c["short"]).otherwise(c["long"])
        goes_on = (acc["k"] > 0) & (grown <= PASSAGE_MOST) & ((grown <= PASSAGE_TARGET) | (acc["size"] < PASSAGE_LEAST))
        own = F.filter(F.array(c["ordinal"], c["header"]), lambda x: x > 0)
        return F.struct(
            F.when(goes_on, acc["cuts"]).otherwise(F.array_append(acc["cuts"], acc["k"])).alias("cuts"),
            F.when(goes_on, grown).otherwise(c["long"]).alias("size"),
            F.when(goes_on, F.array_union(acc["seen"], own)).otherwise(own).alias("seen"),
            (acc["k"] + 1).alias("k"),
        )

    return F.aggregate(kids, begin, step)["cuts"]


def _passages(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(_row, _key, passage, kids): the children of each passage, sorted."""
    c = _children(rows, key, text)
    w = Window.partitionBy("_row").orderBy("ordinal", "part")
    a = F.lag(F.struct("ordinal", "kind", "parent", "end", "last_line")).over(w)
    c = c.withColumn("a", a)
    over_rule = (F.col("a.kind") == "TABLE_ROW") & (F.col("kind") == "TABLE_ROW") & (F.col("ordinal") == F.col("a.ordinal") + 2) & (F.col("header") == F.col("a.ordinal"))
    touches = (F.col("a.parent") == F.col("parent")) & (F.col("start") >= F.col("a.end")) & (F.col("first_line") <= F.col("a.last_line") + 2) & ((F.col("ordinal") - F.col("a.ordinal")).isin(0, 1) | over_rule)
    c = c.withColumn("run", F.sum((~F.coalesce(touches, F.lit(False))).cast("int")).over(w))
    kid = F.struct("ordinal", "part", "kind", "parent", "header", "first_line", "last_line", "start", "end", "content", "own", "retrieval", F.length("own").alias("short"), F.length("retrieval").alias("long"))
    runs = c.groupBy("_row", "_key", "run").agg(F.sort_array(F.collect_list(kid)).alias("kids")).withColumn("cuts", _starts(F.col("kids")))
    cut = runs.select("_row", "_key", "run", "kids", F.posexplode("cuts").alias("k", "at"), F.expr("array_append(slice(cuts, 2, size(cuts)), size(kids))").alias("ends"))
    part = F.slice("kids", F.col("at") + 1, F.element_at("ends", F.col("k") + 1) - F.col("at"))
    return cut.select("_row", "_key", F.row_number().over(Window.partitionBy("_row").orderBy("run", "k")).alias("passage"), part.alias("kids"))


def _retrieval(kids: Column) -> Column:
    """The retrieval text of a passage, in which a table's head appears once."""
    seen = lambda k, c: F.exists(F.slice(kids, 1, k), lambda p: (p["ordinal"] == c["header"]) | (p["header"] == c["header"]))
    return F.array_join(F.transform(kids, lambda c, k: F.when((c["header"] > 0) & seen(k, c), c["own"]).otherwise(c["retrieval"])), "\n")


def _each(kids: Column, name: str) -> Column:
    return F.transform(kids, lambda c: c[name])


def _shaped(found: DataFrame) -> DataFrame:
    """The columns of a passage beside its children."""
    first, last = F.element_at("kids", 1), F.element_at("kids", -1)
    place = [first["parent"].alias("parent"), first["first_line"].alias("first_line"), last["last_line"].alias("last_line"), first["start"].alias("start"), last["end"].alias("end")]
    heads = F.filter(F.array_distinct(_each(F.col("kids"), "header")), lambda x: x > 0)
    content, inside = F.array_join(_each(F.col("kids"), "content"), "\n"), F.array_distinct(_each(F.col("kids"), "ordinal"))
    return found.select("*", *place, inside.alias("blocks"), heads.alias("headers"), F.size("kids").alias("n_children"), content.alias("content"), _retrieval(F.col("kids")).alias("retrieval"))


def passages(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, passage, parent, lines, offsets, blocks, headers, n_children, content, retrieval), of the children that `children` gives."""
    return _shaped(_passages(rows, key, text)).select(F.col("_key").alias(key), "passage", "parent", "first_line", "last_line", "start", "end", "blocks", "headers", "n_children", "content", "retrieval")


# Headings around passages

HEADING_MARK = r"^\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$"
PATH_MOST, PATH_JOIN = 120, " > "


def _paths(blocks: DataFrame) -> DataFrame:
    """(_row, ordinal, path, path_blocks) of each heading: the heading of the next higher level above it, if both have levels, and itself.

    A heading without a level stands alone and ends the levels before it. A path that is too long loses its first part,
    then its end.
    """
    h = blocks.where("kind = 'HEADING'").select("_row", "ordinal", "content", F.regexp_extract("content", HEADING_MARK, 1).alias("marks"))
    h = h.withColumn("level", F.length("marks")).withColumn("title", F.regexp_replace(F.when(F.col("level") > 0, F.regexp_extract("content", HEADING_MARK, 2)).otherwise(F.col("content")), _EDGES, ""))
    order = Window.partitionBy("_row").orderBy("ordinal")
    h = h.withColumn("stretch", F.sum((F.col("level") == 0).cast("int")).over(order))
    before = Window.partitionBy("_row", "stretch").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    lasts = [F.last(F.when(F.col("level") == k, F.struct("ordinal", "title")), ignorenulls=True).over(before) for k in range(1, 7)]
    h = h.withColumn("lasts", F.array(*lasts))
    h = h.withColumn("up", F.when(F.col("level") > 1, F.array_max(F.slice("lasts", 1, F.greatest(F.col("level") - 1, F.lit(1))))))
    both = F.concat_ws(PATH_JOIN, "up.title", "title")
    two = F.col("up").isNotNull() & (F.length(both) <= PATH_MOST)
    return h.select("_row", "ordinal", F.when(two, both).otherwise(F.left("title", F.lit(PATH_MOST))).alias("path"), F.when(two, F.array("up.ordinal", "ordinal")).otherwise(F.array("ordinal")).alias("path_blocks"))


def heading_paths(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ordinal, path, path_blocks) of each heading."""
    b = stored(_blocks(rows, key, text), "blocks")
    return b.where("kind = 'HEADING'").select("_row", "_key", "ordinal").join(_paths(b), ["_row", "ordinal"]).select(F.col("_key").alias(key), "ordinal", "path", "path_blocks")


def contextual_passages(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """passages with path and contextual, the retrieval text behind the path of its heading; passages above all headings have none."""
    rows = stored(rows.select(F.monotonically_increasing_id().alias("_n"), F.col(key).alias("_k"), F.col(text).alias("_t")), "texts")  # both sides know rows by number
    found = passages(rows, "_n", "_t")
    paths = heading_paths(rows, "_n", "_t").select("_n", F.col("ordinal").alias("parent"), "path")
    both = found.join(paths, ["_n", "parent"], "left").join(rows.select("_n", "_k"), "_n")
    return both.select(F.col("_k").alias(key), *[c for c in found.columns if c != "_n"], "path", F.concat_ws("\n", "path", "retrieval").alias("contextual"))


def manifests(rows: DataFrame, key: str, text: str = "text", name: str = "structure-manifest-v1") -> DataFrame:
    """(key, n_passages, n_children, digest): one digest over all passages and children of a document, in their order."""
    found = _shaped(_passages(rows.withColumn("_both", F.struct(F.col(key).alias("k"), F.sha2(text, 256).alias("whole"))), "_both", text))
    sha = lambda c: F.sha2(c, 256)
    kid = lambda c: F.struct(c["ordinal"].alias("ordinal"), c["part"].alias("part"), c["kind"].alias("kind"), sha(c["content"]).alias("sha"), c["first_line"].alias("first_line"), c["last_line"].alias("last_line"), c["start"].alias("start"), c["end"].alias("end"), c["parent"].alias("parent"), c["header"].alias("header"))
    one = F.struct("passage", sha(F.col("content")).alias("sha"), sha(F.col("retrieval")).alias("retrieval"), "first_line", "last_line", "start", "end", "parent", "blocks", "headers", F.transform("kids", kid).alias("kids"))
    whole = found.groupBy("_row", "_key").agg(F.sort_array(F.collect_list(one)).alias("all"))

    @F.pandas_udf("string")
    def digest(docs: pd.Series, whole: pd.Series) -> pd.Series:
        ids = lambda numbers: [str(n) for n in numbers if n]

        def told(found, text_sha: str) -> str:
            heads, parts = [], []
            for p in found:
                place = tuple(int(p[c]) for c in ("first_line", "last_line", "start", "end"))
                heads.append((str(p["passage"]), int(p["passage"]) - 1, p["sha"], p["retrieval"], *place, str(p["parent"]), text_sha, ids(p["blocks"]), ids(p["headers"])))
                for k, c in enumerate(p["kids"]):
                    where = tuple(int(c[x]) for x in ("first_line", "last_line", "start", "end"))
                    parts.append((f"{c['ordinal']}.{c['part']}", len(parts), k, str(p["passage"]), c["kind"], c["sha"], *where, str(c["parent"]), text_sha, ids([c["ordinal"]]), ids([c["header"]])))
            return manifest_digest(name, heads, parts)

        return pd.Series([told(d, w) for d, w in zip(docs, whole, strict=True)])

    n_children = F.aggregate("all", F.lit(0), lambda n, p: n + F.size(p["kids"]))
    return whole.select(F.col("_key.k").alias(key), F.size("all").alias("n_passages"), n_children.alias("n_children"), digest("all", "_key.whole").alias("digest"))
