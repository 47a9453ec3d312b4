"""Operator 4: byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file (base64 bytes and a rank a line) becomes a tokenizers model: bytes are written as the
printable characters of the byte table, and every way to split a token into two known tokens becomes a
merge, ranked by the token it makes. Decoding reverses the byte table, so bytes of characters that were
split between tokens come together again.

Defined cases: null text is encoded as the empty text (no ids); null ids decode to no bytes; rows keep
their order within a partition, repeated rows and null ids of documents pass through; other columns are
not carried.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from .common import slices
from .encoding import CachedEncoder


@lru_cache(1)
def byte_chars() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next free one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(2)
def tokenizer_of(path: str, pattern: str) -> Tokenizer:
    """The tokenizers model of a rank file; a whole match that is a token is taken as it is."""
    ranks, chars = read_ranks(path), byte_chars()
    write = lambda x: "".join(chars[b] for b in x)
    merges = [(write(t[:k]), write(t[k:])) for t in sorted(ranks, key=ranks.get) for k in range(len(t) - 1, 0, -1) if t[:k] in ranks and t[k:] in ranks]
    out = Tokenizer(models.BPE(vocab={write(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    out.encode_special_tokens = True
    return out


@lru_cache(2)
def _encoder(path: str, pattern: str) -> CachedEncoder:
    return CachedEncoder(tokenizer_of(path, pattern))


@lru_cache(2)
def _bytes_of(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all tokens, start and length of each); ranks without a token have no bytes."""
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for t, r in ranks.items():
        tokens[r] = t
    size = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """(id_col, ids array<int>); with offsets also starts and ends (code points) of each token's characters."""
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids array<int>" + ", starts array<int>, ends array<int>" * offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if offsets:
            tokenizer = tokenizer_of(path, pattern)
        else:
            encoder = _encoder(path, pattern)
        for batch in slices(batches, text_col, 500_000 if offsets else 2_000_000):
            if offsets:
                found = tokenizer.encode_batch([t or "" for t in batch.column(text_col).to_pylist()], add_special_tokens=False)
                cols = [pa.array([e.ids for e in found], pa.list_(pa.int32()))] + [pa.array([[o[k] for o in e.offsets] for e in found], pa.list_(pa.int32())) for k in (0, 1)]
            else:
                ids, counts = encoder.flat(batch.column(text_col))
                cols = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(ids.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *cols], [id_col, "ids", "starts", "ends"][: 1 + len(cols)])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, ids_col, decoded binary): the bytes of the ids, joined. Ids outside the vocabulary raise an error."""
    schema = f"`{id_col}` {dict(encoded.dtypes)[id_col]}, `{ids_col}` array<int>, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, start, size = _bytes_of(path)
        for batch in slices(batches, ids_col, 2_000_000):
            ids = batch.column(ids_col)
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            if len(flat) and not (0 <= flat.min() and flat.max() < len(size)):
                raise ValueError(f"ids outside 0 to {len(size) - 1}")
            count = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            wide, first = size[flat], np.concatenate(([0], np.cumsum(count)))
            ends = np.concatenate(([0], np.cumsum(wide)))
            text = data[np.arange(ends[-1]) + np.repeat(start[flat] - ends[:-1], wide)]
            out = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends[first].astype(np.int32)), pa.py_buffer(text)])
            yield pa.RecordBatch.from_arrays([batch.column(id_col), ids, out], [id_col, ids_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, schema)


def decode_text(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, ids_col, text): like decode, as text; bytes that make no character become U+FFFD."""
    schema = f"`{id_col}` {dict(encoded.dtypes)[id_col]}, `{ids_col}` array<int>, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b.decode("utf-8", "replace") for b in batch.column("decoded").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column(ids_col), pa.array(texts, pa.string())], [id_col, ids_col, "text"])

    return decode(encoded, path, id_col, ids_col).mapInArrow(run, schema)
