"""Text functions: chunks, tokens, numbers and overlaps; all of them column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A letter or digit and what may follow it, up to the last that is no dot, underscore or hyphen.
TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}+#]*+(?:[._-]++[\p{L}\p{N}+#]++)*+"
NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def chunks(rows: DataFrame, text_col: str, size: int = 800, overlap: int = 120) -> DataFrame:
    """One row per window of size code points, each starting size - overlap after the last; stripped, blank ones dropped."""
    step = size - overlap
    last = F.greatest(F.lit(0).cast("long"), F.ceil((F.length(text_col) - size) / step))
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    content = strip(F.substring(text_col, (F.col("_i") * step + 1).cast("int"), F.lit(size)))
    return rows.withColumn("chunk_no", F.col("_i") + 1).withColumn("content", content).drop("_i", text_col).where("content <> ''")


def tokens(text: Column) -> Column:
    """Lower-case tokens in order, without trailing dots, underscores and hyphens."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def canonical_number(x: Column) -> Column:
    """Without commas, leading zeros and trailing fraction zeros."""
    plain = F.regexp_replace(F.regexp_replace(x, ",", ""), "^0+(?=[0-9])", "")
    return F.when(plain.contains("."), F.regexp_replace(F.regexp_replace(plain, "0+$", ""), "[.]$", "")).otherwise(plain)


def number_tokens(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), 1), canonical_number))


def coverage(required: Column, had: Column) -> Column:
    """The share of required tokens that are had; 0 of none."""
    return F.when(F.size(required) > 0, F.size(F.array_intersect(required, had)) / F.size(required)).otherwise(F.lit(0.0))


def boundary_overlap(left: Column, right: Column, least: int = 80, share: float = 0.3) -> Column:
    """The longest suffix of left that is a prefix of right, if at least `least` and `share` of the shorter; else 0."""
    n = F.least(F.length(left), F.length(right))
    low = F.greatest(F.lit(least), F.ceil(n * share).cast("int"))
    # such a suffix begins with the first `low` characters of right, and the longest where left first has them: few pairs hold
    # them at all, and only where left has them again before its end are all sizes tried
    first = F.length(left) - F.instr(left, F.left(right, low)) + 1
    fits = lambda k: (k <= n) & (F.right(left, k) == F.left(right, k))
    sizes = F.get(F.filter(F.sequence(n, low, F.lit(-1)), fits), F.lit(0))
    found = F.when(fits(first), first).otherwise(F.coalesce(sizes, F.lit(0)))
    return F.when((n >= low) & F.contains(left, F.left(right, low)), found).otherwise(F.lit(0))


def shares_stretch(a: Column, b: Column, size: Column) -> Column:
    """Whether a and b share any stretch of size (at least 6) characters.

    Whatever stretch of b that is, it holds one of size - g + 1 characters that begins at a multiple of g, so a must hold one
    of those few; only then every stretch of a is tried, from its end, where neighbours overlap.
    """
    step = F.floor(size / 6).cast("int")
    part = size - step + 1
    starts = F.when(F.length(b) >= size, F.sequence(F.lit(0), F.length(b) - part, step)).otherwise(F.array().cast("array<int>"))
    some = F.exists(starts, lambda i: F.contains(a, F.substring(b, i + 1, part)))
    ends = F.when(some & (F.length(a) >= size), F.sequence(F.length(a) - size + 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.exists(ends, lambda i: F.contains(b, F.substring(a, i, size)))
