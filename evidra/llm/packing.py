"""Operator 10: sum-of-squares packing of token sequences.

Documents become token ids and an end id; only those longer than a sequence are cut, and then the first
piece takes the remainder, so that all others are full. Full pieces are sequences of their own. The other
pieces are dealt by a hash of their row number to groups of about `group_size` pieces (so a task's work is bounded at any input
size), and each goes where the sum over all gaps of the squared number of open sequences with that gap
becomes smallest. Pieces are taken by falling length.

Defined cases: null text is the empty text (one piece: the end id); repeated rows are packed each; rows
with a null id are packed like others; other columns are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import free_name, slices, stored
from .encoding import CachedEncoder


@lru_cache(2)
def _encoder(path: str) -> CachedEncoder:
    return CachedEncoder(Tokenizer.from_file(path))


def pieces(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32[, ids]): each document's ids and end_id in pieces of at most size; ids as little-endian uint32."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, text_col, 2_000_000):
            rows = []
            flat, counts = encoder.flat(batch.column(text_col))
            every, at = flat.tobytes(), 0
            for k, count in enumerate(counts.tolist()):
                raw = every[4 * at : 4 * (at + count)] + end
                at, n = at + count, count + 1
                cuts = [0, *range((n - 1) % size + 1, n + 1, size)]
                for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = raw[4 * a : 4 * b]
                    rows.append((k, p, a, b - a, zlib.crc32(part), part if with_ids else None))
            k, p, a, n, crc, ids = zip(*rows, strict=True)
            cols = [batch.column(id_col).take(pa.array(k, pa.int32())), pa.array(p, pa.int32()), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def sum_of_squares(sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, placed in the given order; 1 <= length <= size."""
    count = np.zeros(size + 1, np.int64)  # open sequences by gap; gap 0 is closed and never counts
    open_at: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
    sequence, offset, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        best, gap = 2 * count[size - s] + 1 if s < size else 0, size
        if s < size:
            left = count[: size - s] if s else count
            change = 2 * (left - count[s:size]) + 2
            change[0] -= 1  # the gap becomes 0: nothing is added
            change = np.where(count[s:size] > 0, change, best + 1)
            k = int(change.argmin())
            if change[k] <= best:
                gap = s + k
        if gap == size:
            sequence[i], offset[i] = made, 0
            at = made
            made += 1
        else:
            at = open_at[gap].pop()
            count[gap] -= 1
            sequence[i], offset[i] = at, size - gap
        if gap > s:
            count[gap - s] += 1
            open_at[gap - s].append(at)
    return sequence, offset


def pack(parts: DataFrame, size: int = 1024, group_size: int = 50_000, id_col: str = "doc_id", length_col: str = "length") -> DataFrame:
    """parts and (sequence_id, offset). parts needs id_col, piece and a length from 1 to size; it is read twice.

    Groups go by row numbers of the stored parts, so that no id or content can make one group large.
    """
    n = parts.count()
    groups = max(1, -(-n // group_size))
    group = free_name(parts, "_group")
    kind = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([length_col, id_col, "piece"], ascending=[False, True, True], ignore_index=True)
        sequence, offset = sum_of_squares(part[length_col].to_numpy(), size)
        return part.drop(columns=group).assign(sequence_id=key[0] * (1 << 32) + sequence, offset=offset)

    return parts.withColumn(group, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))).groupBy(group).applyInPandas(run, kind)


def pack_documents(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of all documents, packed: (id_col, piece, start, length, ids_crc32[, ids], sequence_id, offset)."""
    return pack(stored(pieces(docs, path, size, end_id, id_col, text_col, with_ids), "pieces"), size, id_col=id_col)
