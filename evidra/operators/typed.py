"""Typed constraints in three-valued logic: SATISFIED, CONTRADICTED, UNKNOWN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ATOM_EXAMPLES = ["2024", "2024-02", "2024-02-29", "2023-02-29", "2024.3", "2024/12/05", "1999-13", "x", ""]
QUESTIONS = ["Version 2.0 of the license", "Version 3", "at least 2 days of work", "more than 30 minutes", "over 5 copies of the program", "Apache License 2.0"]
_DATE = r"^([0-9]{4})(?:[-./]([0-9]{1,2}))?(?:[-./]([0-9]{1,2}))?$"


def date_atoms(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """(raw, first_day, last_day, precision): a closed interval of a year, a month or a day; nulls where it is none."""
    y, m, d = (F.nullif(F.regexp_extract(raw, _DATE, k), F.lit("")).cast("int") for k in (1, 2, 3))
    day = F.lpad(F.coalesce(d, F.lit(1)).cast("string"), 2, "0")
    month = F.lpad(F.coalesce(m, F.lit(1)).cast("string"), 2, "0")
    first = F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), month, day), "yyyy-MM-dd")
    last = F.when(d.isNotNull(), first).when(m.isNotNull(), F.last_day(first)).otherwise(F.make_date(y, F.lit(12), F.lit(31)))
    precision = F.when(d.isNotNull(), "FULL_DATE").when(m.isNotNull(), "YEAR_MONTH").otherwise("YEAR")
    ok = y.isNotNull() & first.isNotNull()
    return rows.select(raw, F.when(ok, first).alias("first_day"), F.when(ok, last).alias("last_day"), F.when(ok, precision).alias("precision"))


# A year alone is any number of four digits, so that only 19xx and 20xx count as one.
DATE_STRING = r"\b([0-9]{4}[-./][0-9]{1,2}(?:[-./][0-9]{1,2})?|(?:19|20)[0-9]{2})\b"


EVALUATE_DUCK = """, s AS (SELECT o_orderkey, CASE WHEN o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' THEN 'SATISFIED' ELSE 'CONTRADICTED' END AS date_state, CASE WHEN o_totalprice >= 100000 THEN 'SATISFIED' ELSE 'CONTRADICTED' END AS amount_state FROM orders)
SELECT *, CASE WHEN 'CONTRADICTED' IN (date_state, amount_state) THEN 'CONTRADICTED' ELSE 'SATISFIED' END AS state FROM s"""


def _state(ok: Column) -> Column:
    return F.when(ok, "SATISFIED").when(~ok, "CONTRADICTED").otherwise("UNKNOWN")


def compare_dates(day: Column, low: Column, high: Column) -> Column:
    """Is a day in the closed interval; UNKNOWN without one."""
    return _state((day >= low) & (day <= high))


def compare_numbers(value: Column, op: str, bound: Column, upper: Column | None = None) -> Column:
    tests = {"EQ": value == bound, "GT": value > bound, "GTE": value >= bound, "LT": value < bound, "LTE": value <= bound}
    if op == "RANGE":
        return _state((value >= bound) & (value <= upper))
    return _state(tests[op])


def qualifier_fits(required: Column, observed: Column) -> Column:
    """Do the required words stand together, in order, among the observed; an empty qualifier fits an empty one only."""
    words = lambda q: F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(q), F.lit(r"([\p{L}\p{N}]+)"), 1), " "), F.lit(" "))
    a, b = words(required), words(observed)
    blank = lambda q: F.trim(q) == ""
    return F.when(blank(required) | blank(observed), blank(required) & blank(observed)).otherwise((F.trim(a) != "") & F.contains(b, a))


def reading_state(c: Column, o: Column) -> Column:
    """One constraint against one observation of its kind, both as `typed_values` reads them.

    UNKNOWN where kinds, qualifiers, units or names do not meet, a wanted direction is not told, or an interval lies
    only partly inside; the opposite direction contradicts.
    """
    low, high = c["low"].cast("decimal(38,10)"), c["high"].cast("decimal(38,10)")
    value = o["low"].cast("decimal(38,10)")
    number = F.when(c["op"] == "RANGE", value.between(low, high))
    for op, test in {"EQ": value == low, "GT": value > low, "GTE": value >= low, "LT": value < low, "LTE": value <= low}.items():
        number = number.when(c["op"] == op, test)
    inside = {"EQ": (o["low"] >= c["low"]) & (o["high"] <= c["high"]), "GT": o["low"] > c["high"], "GTE": o["low"] >= c["low"], "LT": o["high"] < c["low"]}
    outside = {"EQ": (o["high"] < c["low"]) | (o["low"] > c["high"]), "GT": o["high"] <= c["high"], "GTE": o["high"] < c["low"], "LT": o["low"] >= c["low"]}
    date = F.when(F.lit(False), "UNKNOWN")
    for op in inside:
        same = c["op"].isin("EQ", "RANGE") if op == "EQ" else c["op"] == op
        date = date.when(same & inside[op], "SATISFIED").when(same & outside[op], "CONTRADICTED")
    fits = qualifier_fits(c["qualifier"], o["qualifier"])
    measured = (c["kind"] == "QUANTITY") & fits & (c["unit"] == o["unit"])
    against = measured & (c["direction"] != "NONE") & (o["direction"] != c["direction"])
    return (
        F.when(c["kind"] != o["kind"], "UNKNOWN")
        .when(against, F.when(o["direction"] == "NONE", "UNKNOWN").otherwise("CONTRADICTED"))
        .when(measured, _state(number))
        .when((c["kind"] == "DATE") & fits, F.coalesce(date, F.lit("UNKNOWN")))
        .when((c["kind"] == "IDENTIFIER_NUMBER") & (c["name"] == o["name"]), _state(c["low"] == o["low"]))
        .when((c["kind"] == "LITERAL") & (c["name"] == o["name"]), "SATISFIED")
        .otherwise("UNKNOWN")
    )


def any_of(*states: Column) -> Column:
    """Over observations of one constraint: one satisfied is enough, else one contradicted."""
    every = F.array(*states)
    return F.when(F.array_contains(every, "SATISFIED"), "SATISFIED").when(F.array_contains(every, "CONTRADICTED"), "CONTRADICTED").otherwise("UNKNOWN")


def all_of(*states: Column) -> Column:
    """Over constraints: one contradicted decides, then one unknown."""
    every = F.array(*states)
    return F.when(F.array_contains(every, "CONTRADICTED"), "CONTRADICTED").when(F.array_contains(every, "UNKNOWN"), "UNKNOWN").otherwise("SATISFIED")


def stable_partition(rows: DataFrame, query: str, rank: str, state: str = "state") -> DataFrame:
    """new_rank: satisfied first, then unknown, then contradicted, each in the old order."""
    order = F.when(F.col(state) == "SATISFIED", 0).when(F.col(state) == "UNKNOWN", 1).otherwise(2)
    return rows.withColumn("new_rank", F.row_number().over(Window.partitionBy(query).orderBy(order, rank)).cast("long"))
