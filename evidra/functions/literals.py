"""Literal anchors of a query: numbers with units, number codes, English phrases and identifiers, as an Arrow function."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from .slices import by_slices

# The four kinds, in the order in which they are tried, and acronyms without weight.
KINDS = (
    ("NUMERIC_UNIT", regex.compile(r"(?i)(?<![0-9])(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+(?:\.[0-9]+)?)(?:회|건|행|명|개|초|분|시간|ms|s|mb|gb|tb|%)")),
    ("CODE_IDENTIFIER", regex.compile(r"(?<![0-9])(?:[0-9]+/){2,}[0-9]+(?![0-9])")),
    ("MULTI_TOKEN_IDENTIFIER", regex.compile(r"(?<![A-Za-z0-9+#._/-])[A-Za-z][A-Za-z0-9+#._/-]*(?:[ \t]+(?:[A-Za-z][A-Za-z0-9+#._/-]*|[vV]?[0-9]+\.[0-9]+))+(?![A-Za-z0-9+#._/-])")),
    ("IDENTIFIER", regex.compile(r"(?<![A-Za-z0-9+#._/-])(?:[A-Z][a-z0-9]+(?:[A-Z][A-Za-z0-9]*)+|[A-Z][A-Z0-9]+|[A-Za-z]+[0-9]+[A-Za-z0-9]*|[A-Za-z][A-Za-z0-9]*[-/][A-Za-z0-9][A-Za-z0-9/-]*)(?![A-Za-z0-9+#._/-])")),
)
GENERIC = frozenset("api db ui ux id".split())
DASHES = regex.compile("[‐‑‒–—]")
PUNCTUATION = regex.compile(r"[!\"$%&'()*,:;<=>?@\[\\\]^`{|}~]+")


def literal_form(text: str) -> str:
    """NFKC in lower case, dashes alike and closed up, other punctuation as spaces."""
    text = DASHES.sub("-", unicodedata.normalize("NFKC", text).lower())
    return " ".join(PUNCTUATION.sub(" ", regex.sub(r"\s*([/-])\s*", r"\1", text)).split())


def literal_anchors_of(query: str) -> list[tuple[str, str, str]]:
    """(value, form, kind) of the matches that no longer one holds, in order, each form once."""
    text = unicodedata.normalize("NFKC", query)
    found = [(m.start(), m.end(), kind) for kind, pattern in KINDS for m in pattern.finditer(text) if literal_form(m[0]) not in GENERIC]
    # by start, longest first (of equal spans the earlier kind): a match lies in a longer one if one before it reaches its end
    reach, out = -1, {}
    for start, end, kind in sorted(found, key=lambda f: (f[0], -f[1])):
        if end > reach:
            reach = end
            form = literal_form(text[start:end])
            if form:
                out.setdefault(form, (text[start:end].strip(), form, kind))
    return list(out.values())


@F.pandas_udf(ArrayType(StructType().add("value", StringType()).add("form", StringType()).add("kind", StringType())))
def literal_anchors(query: pd.Series) -> pd.Series:
    return query.map(lambda q: [dict(zip(("value", "form", "kind"), a)) for a in literal_anchors_of(q)], na_action="ignore")


form = by_slices(literal_form, StringType())


def all_held(anchors: Column, *forms: Column) -> Column:
    """Is every anchor's form in one of the texts' forms; true without anchors. A null text holds nothing.

    The forms must be columns of their own: an Arrow function cannot stand inside a lambda.
    """
    held = lambda a: F.greatest(*[F.coalesce(F.contains(t, a.form), F.lit(False)) for t in (*forms, F.lit(None).cast("string"))])
    return F.forall(anchors, held)
