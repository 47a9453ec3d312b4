"""Job postings as search items: lines are rows, looking ahead is a bounded window, roles and sections are carried forward.

A posting's lines get their signs from column expressions (`functions.posting_lines`). Three things need other lines:

* what follows: the signs of the next ten lines that are not blank are bits of two numbers, counted without a loop;
* the block a line is in (job content, form, metadata, legal, excluded): the last line that opens one counts. Whether a line
  opens a block may depend on the block before it, so the form state is carried first, then the block, then the return
  from an excluded block;
* the role of the section (searchable or not): the last heading that says it counts; between two of them a role can only
  move from excluded to unknown to searchable.

Lines of searchable sections become items: list lines whole, others by sentences, each at most `limit` UTF-16 units.
All windows have one order, so a posting's lines are sorted once. They are one group of the windows; a posting of any length is sorted there, never held in Python. Postings
are dealt to tasks by a fixed number of them, before they are cut into lines, so that no task's windows grow with the input.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import posting_lines as pl
from ..sources.work import spread

LIMIT, MOST = 500, 100
TOGETHER = 500  # postings of a task: all windows of a stage hold its lines at once
_DELIMITERS = ".?!。？！;；,，:："


def _in_order() -> WindowSpec:
    return Window.partitionBy("posting").orderBy("line")


def _so_far() -> WindowSpec:
    return _in_order().rowsBetween(Window.unboundedPreceding, 0)


def _since(start: Column, hit: Column) -> Column:
    """Whether a line hit, from the last line where start is not null (or from the first line) up to this one: by the numbers
    of lines, so that stretches need no sort of their own."""
    last = lambda c: F.coalesce(F.max(F.when(c, F.col("line"))).over(_so_far()), F.lit(-1))
    return F.coalesce(F.max(F.when(hit, F.col("line"))).over(_so_far()), F.lit(-2)) >= last(start.isNotNull())


def lines(postings: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(posting, line, text, level, heading, context, grouping, signs): the lines that are not blank."""
    raw = F.split(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), pl.LINE_ENDS, "\n"), "\n")
    rows = spread(postings, id_col, TOGETHER).select(F.col(id_col).alias("posting"), F.posexplode(raw).alias("line", "raw"))
    rows = rows.withColumn("flat", pl.flat(F.col("raw"))).withColumn("plain", pl.bare(F.col("flat"))).withColumn("item", pl.without_bullets(F.col("plain")))
    told = rows.select("posting", "line", pl.parsed(F.col("raw"), F.col("plain"), F.col("item")).alias("p"))
    # blank lines go inside the generator: a filter would be pushed below all of this and parse every line twice
    return pl.with_signs(told.select("posting", "line", F.inline(F.filter(F.array("p"), lambda p: p["text"] != ""))))


NEXT, EACH = 10, 6  # lines ahead, and bits of each in a number
_AHEAD = (("known", "opens", "leaf", "field", "asks", "block_meta"), ("weak", "firm", "listed", "other", "names"))


def _following(most: int, stop: str, hit: str) -> Column:
    """How many of the next most lines hit, up to the first that stops: bits of lines below the lowest bit of a stop."""
    word = next(k for k, names in enumerate(_AHEAD) if stop in names)
    every = F.lit(sum(1 << EACH * k for k in range(most))).cast("long")
    bits = lambda name: F.shiftright(F.col(f"ahead{word}"), _AHEAD[word].index(name)).bitwiseAND(every)
    lowest = bits(stop).bitwiseAND(-bits(stop))
    return F.bit_count(bits(hit).bitwiseAND(lowest - F.lit(1).cast("long")))


def headed(rows: DataFrame) -> DataFrame:
    """rows with titled, whether a line is a heading: by itself, or as a short line before a list or two strong requirements."""
    plain = lambda s: s["strong"] & ~s["told"] & ~s["meta"]
    one, two = F.lead("signs", 1).over(_in_order()), F.lead("signs", 2).over(_in_order())
    run = F.coalesce(one["listed"] | (plain(one) & plain(two)), F.coalesce(one["listed"], F.lit(False)))
    return rows.withColumn("titled", F.col("signs.told") | (F.col("signs.maybe") & run))


def ahead_of(rows: DataFrame) -> DataFrame:
    """rows with what the next lines say: leaf5 and leaf4 (requirements or technologies), form, metadata, intro, run, parent."""
    s = F.col("signs")
    titled, kind = F.col("titled"), s["kind"]
    weak, names = titled | s["meta"] | ~s["strong"], ~titled & s["tech"]
    told = {
        "known": titled & (kind != "UNKNOWN"), "opens": titled & (kind == "SEARCHABLE"), "leaf": s["need"] | s["tech"], "field": s["field"], "asks": s["asks"], "block_meta": s["block_meta"],
        "weak": weak, "firm": ~weak, "listed": s["listed"], "other": ~names, "names": names,
    }
    number = lambda names: sum((F.when(told[n], 1 << k).otherwise(0) for k, n in enumerate(names)), F.lit(0)).cast("long")
    rows = rows.withColumns({f"_bits{k}": number(names) for k, names in enumerate(_AHEAD)})
    later = lambda c, k: F.coalesce(F.lead(c, k).over(_in_order()), F.lit(0).cast("long"))
    rows = rows.withColumns({f"ahead{w}": sum((F.shiftleft(later(f"_bits{w}", k + 1), EACH * k) for k in range(NEXT)), F.lit(0).cast("long")) for w in range(len(_AHEAD))})
    nxt = F.lead(F.struct(s["listed"].alias("listed"), (s["listed"] & s["need"]).alias("asked"), "level"), 1).over(_in_order())
    rows = rows.withColumn("_next", nxt)
    nxt, bullet = F.col("_next"), F.coalesce(F.col("_next.asked"), F.lit(False))
    strong = _following(4, "weak", "firm")
    asked = F.when(s["applies"], _following(10, "opens", "field")).otherwise(_following(10, "opens", "asks"))
    wanted = F.when(s["applies"], 2).otherwise(3) - s["asks"].cast("int")
    return rows.select(
        "*",
        (_following(4, "known", "leaf") >= 1).alias("some_leaf"),
        (_following(5, "known", "leaf") >= 2).alias("leaves"),
        bullet.alias("bullet"),
        (~s["listed"] & ~s["ended"] & (s["applies"] | s["asks"]) & (asked >= wanted)).alias("form"),
        (s["pay"] | (~s["listed"] & ~s["ended"] & s["pays"] & (_following(8, "opens", "block_meta") >= 2))).alias("metadata"),
        (~s["listed"] & s["ended"] & ~s["need"] & (_following(3, "other", "names") >= 2)).alias("intro"),
        (~s["listed"] & s["strong"] & ((strong >= 2) | (~s["ended"] & (_following(4, "weak", "listed") >= 1)))).alias("run"),
        F.coalesce(F.col("grouping") & s["listed"] & nxt["listed"] & (nxt["level"] > F.col("level")), F.lit(False)).alias("parent"),
    ).drop("_next", *[f"{name}{k}" for name in ("_bits", "ahead") for k in range(len(_AHEAD))])


def blocked(rows: DataFrame) -> DataFrame:
    """rows with block: JOB, FORM, METADATA, LEGAL, EXCLUDED or UNKNOWN."""
    s = F.col("signs")
    searchable = F.col("titled") & (s["kind"] == "SEARCHABLE")
    job = s["inline"] | (searchable & (F.col("some_leaf") | F.col("bullet")))
    # the form state, with those headings apart that end all but a form
    form = F.when(job, False).when(F.col("form"), F.when(~searchable, True)).when(F.col("metadata"), False)
    rows = rows.withColumn("in_form", F.coalesce(F.last(form, ignorenulls=True).over(_in_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    opened = F.when(job | (searchable & ~F.col("in_form")), "JOB").when(F.col("form"), "FORM").when(F.col("metadata"), "METADATA")
    opened = opened.when(F.col("titled") & (s["kind"] == "EXCLUDED") & ~F.col("in_form"), F.when(s["legal"], "LEGAL").otherwise("EXCLUDED"))
    rows = rows.withColumn("opened", opened)
    back = F.col("opened").isNull() & ((F.col("titled") & (F.col("leaves") | F.col("bullet"))) | F.col("run"))
    last = F.coalesce(F.last("opened", ignorenulls=True).over(_so_far()), F.lit("UNKNOWN"))
    block = F.when((last == "EXCLUDED") & _since(F.col("opened"), back), "JOB").otherwise(last)
    return rows.withColumn("block", block).drop("in_form", "opened")


def sectioned(rows: DataFrame) -> DataFrame:
    """rows with skipped (in a block that is left out, or metadata), before and role (SEARCHABLE, EXCLUDED, UNKNOWN), section and group."""
    s = F.col("signs")
    whole = Window.partitionBy("posting")
    structured = (F.max(F.col("titled") & (s["kind"] != "UNKNOWN")).over(whole)) | (F.sum(s["strong"].cast("int")).over(whole) >= 2)
    rows = rows.withColumn("structured", structured).withColumn("skipped", F.col("block").isin("FORM", "METADATA", "LEGAL", "EXCLUDED") | s["meta"])
    heads, plain = ~F.col("skipped") & F.col("titled"), ~F.col("skipped") & ~F.col("titled") & ~F.col("parent")
    start = F.when(F.col("structured"), "UNKNOWN").otherwise("SEARCHABLE")
    said = F.when(heads & s["kind"].isin("SEARCHABLE", "EXCLUDED"), s["kind"]).when(heads & (s["kind"] == "STRUCTURAL"), "UNKNOWN").when(plain & F.col("run"), "SEARCHABLE")
    rows = rows.withColumn("said", said)
    rows = rows.withColumn("base", F.coalesce(F.last("said", ignorenulls=True).over(_so_far()), start))
    loose = heads & (s["kind"] == "UNKNOWN") & ~F.col("context")
    rows = rows.withColumn("loose", (F.col("base") == "UNKNOWN") | _since(F.col("said"), loose))
    found = _since(F.col("said"), plain & s["inline"] & F.col("loose"))
    role = F.when((F.col("base") == "SEARCHABLE") | found, "SEARCHABLE").when(F.col("loose"), "UNKNOWN").otherwise("EXCLUDED")
    rows = rows.withColumn("role", role)
    rows = rows.withColumn("before", F.coalesce(F.lag("role").over(_in_order()), start))
    inside = ~F.col("skipped") & ~F.col("titled") & (F.col("before") == "SEARCHABLE")
    rows = rows.withColumn("under", inside & s["short"] & F.col("leaves")).withColumn("leads_in", inside & F.col("intro") & ~(s["short"] & F.col("leaves")))
    name = F.regexp_replace(F.col("text"), "[:： ]*[:：]$", "")
    name = F.when(F.length(name) > 0, name)
    turned = (F.col("before") == "UNKNOWN") & s["inline"]  # the section stays with a label that is searchable itself
    fresh = plain & ~F.col("under") & F.col("run") & (F.col("before") != "SEARCHABLE") & ~turned
    section = F.when(heads | F.col("under"), F.struct(name.alias("name"))).when(fresh, F.struct(F.lit(None).cast("string").alias("name")))
    rows = rows.withColumn("section", F.last(section, ignorenulls=True).over(_so_far())["name"])
    ends = F.col("skipped") | F.col("titled") | F.col("under")
    head = F.when(ends, F.struct(F.lit(None).cast("string").alias("name"), F.lit(0).alias("level"))).when(F.col("parent") & ~F.col("leads_in"), F.struct(name.alias("name"), "level"))
    rows = rows.withColumn("head", head)
    rows = rows.withColumn("above", F.last("head", ignorenulls=True).over(_so_far()))
    out = F.col("head").isNull() & ~F.col("leads_in") & (~s["listed"] | (F.col("level") <= F.col("above.level")))
    left = _since(F.col("head"), out)
    rows = rows.withColumn("group", F.when(F.col("head").isNull() & ~left, F.col("above.name")))
    return rows.drop("said", "base", "loose", "head", "above")


def pieces(text: str, limit: int = LIMIT) -> list[str] | None:
    """text in pieces of at most limit UTF-16 units, cut behind the last delimiter before a blank, else at the last blank, else
    anywhere but within a character; what is left keeps two letters or digits. None if that cannot be."""
    raw = text.encode("utf-16-be", "surrogatepass")
    units = "".join(chr(int.from_bytes(raw[k : k + 2], "big")) for k in range(0, len(raw), 2))  # one character a unit
    whole = lambda x: b"".join(ord(c).to_bytes(2, "big") for c in x).decode("utf-16-be", "surrogatepass").strip()
    worth = lambda x: sum(c.isalpha() or c.isdecimal() for c in whole(x)) >= 2
    cuts = (re.compile(rf".{{1,{limit - 1}}}[{_DELIMITERS}](?= |$)", re.S), re.compile(rf".{{1,{limit - 1}}}(?= )", re.S), re.compile(rf".{{1,{limit}}}(?<![\ud800-\udbff])", re.S))
    out = []
    while len(units) > limit:
        for cut in cuts:
            at = m.end() if (m := cut.match(units)) else 0
            while at and (rest := units[at:].strip()) and not worth(rest):
                at -= 2 if 0xDC00 <= ord(units[at - 1]) < 0xE000 else 1
            if at and worth(units[:at]):
                break
        else:
            return None
        out.append(whole(units[:at]))
        units = units[at:].lstrip(" ")
    if units and not worth(units):
        return None
    return [*out, whole(units)] if units else out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _pieces(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else pieces(t))


def segments(postings: DataFrame, id_col: str = "posting_id", text_col: str = "text") -> DataFrame:
    """(id_col, item_id, section, text, fault): the items of each posting, numbered in their order.

    A posting with more than MOST items, or with an item that cannot be cut, has one row with the fault and no item. Null
    texts, and postings without items, have none. Rows that repeat an id are one posting only if they are one row, so ids
    must be unique.
    """
    rows = sectioned(blocked(ahead_of(headed(lines(postings, id_col, text_col)))))
    s = F.col("signs")
    kept = ~F.col("structured") | (F.col("role") == "SEARCHABLE") | ((F.col("role") == "UNKNOWN") & ((s["listed"] & s["need"]) | s["inline"]))
    leaf = rows.where(~F.col("skipped") & ~F.col("titled") & ~F.col("under") & ~F.col("leads_in") & ~F.col("parent") & kept)
    sentences = F.split(F.regexp_replace("text", f"([{pl.ENDS}]++[{pl.CLOSING}]*+)(?: |$)", "$1\n"), "\n")
    items = leaf.select("posting", "line", F.coalesce("group", "section").alias("section"), F.posexplode(F.when(s["listed"], F.array("text")).otherwise(sentences)).alias("k", "item"))
    items = items.withColumn("item", pl.tidy(F.col("item"))).where(pl.worth_reading(F.col("item")))
    first = F.row_number().over(Window.partitionBy("posting", "item").orderBy("line", "k"))
    items = items.withColumn("first", first).where("first = 1")
    long = F.octet_length(F.encode("item", "UTF-16BE")) > 2 * LIMIT
    items = items.withColumn("cut", _pieces(F.when(long, F.col("item")))).withColumn("fault", F.when(long & F.col("cut").isNull(), "ITEM_TOO_LONG"))
    parts = items.select("posting", "line", "k", "section", "fault", F.posexplode(F.when(long & F.col("cut").isNotNull(), F.col("cut")).otherwise(F.array("item"))).alias("n", "text"))
    whole = Window.partitionBy("posting")
    fault = F.coalesce(F.min("fault").over(whole), F.when(F.count("*").over(whole) > MOST, "TOO_MANY_ITEMS"))
    parts = parts.withColumn("fault", fault).withColumn("item_id", F.row_number().over(Window.partitionBy("posting").orderBy("line", "k", "n")))
    good = F.col("fault").isNull()
    shown = [F.when(good, F.col(c)).alias(c) for c in ("item_id", "section", "text")]
    return parts.where(good | (F.col("item_id") == 1)).select(F.col("posting").alias(id_col), *shown, "fault")
