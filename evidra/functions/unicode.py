"""What SQL has no function for: compatibility normalisation and canonical hashes, as Arrow functions."""

from __future__ import annotations

import hashlib
import re
import struct
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SPACES = re.compile(r"\s+")


@F.pandas_udf(StringType())
def normalized(text: pd.Series) -> pd.Series:
    """NFKC in lower case; null stays null."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t).lower(), na_action="ignore")


@F.pandas_udf(StringType())
def tag_name(text: pd.Series) -> pd.Series:
    """NFKC with white space collapsed; null for blank names and those of over 100 characters."""
    name = text.map(lambda t: _SPACES.sub(" ", unicodedata.normalize("NFKC", t)).strip(), na_action="ignore")
    return name.where(name.str.len().between(1, 100), None)


@F.pandas_udf(StringType())
def canonical_digest(parts: pd.Series) -> pd.Series:
    """SHA-256 of an array of strings, each behind its length as a big-endian 32-bit number; a null's length is -1."""

    def one(values) -> str:
        h = hashlib.sha256(struct.pack(">i", len(values)))
        for v in values:
            raw = None if v is None else v.encode()
            h.update(struct.pack(">i", -1 if raw is None else len(raw)) + (raw or b""))
        return h.hexdigest()

    return parts.map(one, na_action="ignore")


def _packed(value: object) -> bytes:
    """A string behind its length, a number as 32 bits (a float by its bits), lists behind their lengths, a null as one zero byte."""
    if value is None:
        return b"\0"
    if isinstance(value, str):
        return struct.pack(">i", len(value.encode())) + value.encode()
    if isinstance(value, float):
        return struct.pack(">f", value)
    if isinstance(value, int):
        return struct.pack(">i", value)
    return struct.pack(">i", len(value)) + b"".join(map(_packed, value))


def manifest_digest(name: str, *sections: list[tuple]) -> str:
    """SHA-256 of a format's name and its sections: each its number of rows, then their fields in order.

    A field that may be null is given as (present, value): a byte and, if present, the value.
    """
    h = hashlib.sha256(_packed(name))
    for rows in sections:
        h.update(struct.pack(">i", len(rows)))
        for row in rows:
            for field in row:
                optional = isinstance(field, tuple)
                h.update((b"\1" + _packed(field[1]) if field[0] else b"\0") if optional else _packed(field))
    return h.hexdigest()
