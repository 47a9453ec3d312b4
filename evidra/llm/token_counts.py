"""Operator 9: token counts by a map-side two-tier lookup of pre-tokens.

First tier: a compact broadcast table of the lengths of frequent pre-tokens, gathered over all documents by
bounded per-task summaries, one row a task, which are merged as they are; its size is fixed by table_size. Second tier: pre-tokens it lacks go to the
library once per worker (many at a time, as one text) and stay in that worker's cache. No pre-token is a
row of any shuffle. The tables only change speed.

Pre-tokens of texts of Latin, Cyrillic and Han letters and common punctuation are found here, by the vocabulary's
own pattern on the lower-cased text (its normaliser changes nothing else there: such texts are in NFC, and white
space is dropped).
Texts with other characters or with strings of added tokens go to the library whole.

Defined cases: null and empty texts have no bytes and no tokens; strings of special tokens inside texts
count as the library's default has it (one token each); repeated rows and null ids pass through; other
columns are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import discard, slices, stored

# Characters without combining forms, whose lower case is one character.
_KNOWN = r"\x20-\x7e\xa1-\u012f\u0131-\u024f\u0410-\u044f\u2010-\u2027\u2030-\u203a\u20ac\u4e00-\u9fa5"
_ODD = re.compile(rf"[^\t\n\r{_KNOWN}]")


class Counts:
    """The library and the pattern of a vocabulary whose words end with a mark."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        told = json.loads(self.tokenizer.to_str())
        split = next(p for p in told["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        known = [c for c in map(chr, range(0x20AD)) if not _ODD.match(c)]
        kinds = {k: "".join(re.escape(c) for c in known if unicodedata.category(c)[0] == k) + "\u4e00-\u9fa5" * (k == "L") for k in "LN"}
        self.pattern = re.compile(re.sub(r"\\p\{([LN])\}", lambda m: kinds[m[1]], split["pattern"]["Regex"]))
        mark = told["model"]["end_of_word_suffix"]
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[k] = token.endswith(mark)
        self.cache: dict[str, int] = {}

    def pre_tokens(self, text: str) -> list[str] | None:
        """None: the text is the library's."""
        return None if _ODD.search(text) or any(a in text for a in self.added) else self.pattern.findall(text.lower())

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def lengths(self, pre: list[str]) -> list[int]:
        """The tokens of each pre-token, encoded side by side and told apart by their end marks."""
        if not pre:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(pre)], add_special_tokens=False)[0].ids, np.int64)
        at = np.flatnonzero(self.ends[ids])
        if len(at) != len(pre) or at[-1] != len(ids) - 1:
            return self.whole(pre)
        return np.diff(at, prepend=-1).tolist()


@lru_cache(2)
def counts_of(path: str) -> Counts:
    return Counts(path)


def frequent_pre_tokens(docs: DataFrame, path: str, text_col: str = "text", table_size: int = 32_768, summary: int = 4_096, room: int = 100_000, fan: int = 32) -> list[str]:
    """Frequent pre-tokens over all documents. A task counts in bounded room (rare ones are shed) and gives its most
    frequent ones as one row; fan such rows at a time become one, until the last reaches the driver."""
    schema = "pre array<string>, n array<long>"

    def row(count: Counter, most: int) -> pa.RecordBatch:
        top = sorted(count.items(), key=lambda x: (-x[1], x[0]))[:most]
        return pa.RecordBatch.from_arrays([pa.array([[c for c, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], ["pre", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, count = counts_of(path).pre_tokens, Counter()
        for batch in slices(batches, text_col):
            for t in batch.column(text_col).to_pylist():
                count.update(find(t or "") or ())
            if len(count) > room:
                count = Counter(dict(count.most_common(room // 2)))
        yield row(count, summary)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter()
        for batch in batches:
            for pre, n in zip(batch.column("pre").to_pylist(), batch.column("n").to_pylist(), strict=True):
                for c, k in zip(pre, n, strict=True):
                    count[c] += k
        yield row(count, table_size)

    rows = stored(docs.select(text_col).mapInArrow(run, schema), "summaries")
    merged, n = rows, rows.count()
    while n > 1:
        n = -(-n // fan)
        merged = merged.repartition(n).mapInArrow(merge, schema)
    out = [c for r in merged.collect() for c in r.pre]
    discard(rows)
    return out


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", room: int = 400_000, longest: int = 64) -> DataFrame:
    """(id_col, n_bytes, n_tokens). room: pre-tokens in a worker's cache; those longer than longest stay out of the table."""
    top = [c for c in frequent_pre_tokens(docs, path, text_col) if len(c) <= longest]  # at most table_size short strings
    table = docs.sparkSession.sparkContext.broadcast(dict(zip(top, counts_of(path).lengths(top), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counts_of(path)
        if not table.value.keys() <= c.cache.keys():
            c.cache = dict(table.value)
        for batch in slices(batches, text_col):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            parts = [c.pre_tokens(t) for t in texts]
            seen = set().union(*(p for p in parts if p))
            fresh = seen - c.cache.keys()
            if len(c.cache) + len(fresh) > room:
                c.cache = dict(table.value)
                fresh = seen - c.cache.keys()
            fresh = list(fresh)
            c.cache.update(zip(fresh, c.lengths(fresh), strict=True))
            get, rest = c.cache.__getitem__, iter(c.whole([t for t, p in zip(texts, parts, strict=True) if p is None]))
            sizes = [next(rest) if p is None else sum(map(get, p)) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(sizes, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_bytes long, n_tokens long")
