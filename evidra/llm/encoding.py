"""Exact encoding through a cache of chunks.

A text is cut where a character that is no white space is followed by a blank or a line feed, and where an
ASCII letter or digit is followed by ASCII of another kind. No pre-token of these vocabularies holds such
places inside (white space only leads a pre-token, letters end one, digits stand by themselves), so the
chunks' ids, joined, are the text's ids. Texts where that does not hold by itself (other white space,
strings of added tokens) go to the library whole.

The chunks of a slice of texts are one Arrow array; its distinct values are looked up in the worker's cache,
what the cache lacks is encoded by the tokenizers library, and the ids of all texts are gathered by numpy.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

_ODD = re.compile(r"[^\S \n]")
_BREAK = np.zeros(256, bool)
_BREAK[[10, 32]] = True
_KIND = np.zeros(256, np.uint8)  # 1 letters, 2 digits, 4 other printable ASCII, 0 white space and parts of longer characters
_KIND[33:127] = 4
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1


class CachedEncoder:
    """texts -> ids. limit: chunks kept at once by a worker; when they are more, the cache starts anew."""

    def __init__(self, tokenizer: Tokenizer, limit: int = 600_000):
        self.tokenizer, self.limit = tokenizer, limit
        added = tokenizer.get_added_tokens_decoder()
        self.special = re.compile("|".join(re.escape(t.content) for t in added.values())) if added and not tokenizer.encode_special_tokens else None
        self.width = np.zeros(tokenizer.get_vocab_size() + 1, np.int64)  # bytes of each token: one character stands for one byte
        for token, k in tokenizer.get_vocab(with_added_tokens=False).items():
            self.width[k] = len(token)
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.end = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64)
        self.n = 0  # chunks in the cache; chunk k has ids[end[k - 1] : end[k]]

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, chunks: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        used = int(self.end[self.n - 1]) if self.n else 0
        while len(self.ids) < used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.end) < self.n + len(chunks):
            self.end = np.concatenate([self.end, np.zeros_like(self.end)])
        self.ids[used : used + len(ids)] = ids
        self.end[self.n : self.n + len(chunks)] = used + np.cumsum(sizes)
        self.place.update(zip(chunks, range(self.n, self.n + len(chunks)), strict=True))
        self.n += len(chunks)

    def _learn(self, chunks: list[bytes]) -> None:
        """Encode chunks as one text where they may stand side by side (a leading blank, no trailing one), others alone."""
        side = [c for c in chunks if c[0] in b" \n" and c[-1] not in b" \n"]
        if side:
            ids = self._raw([b"".join(side).decode()])[0]
            at = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(c) for c in side]), "left") + 1
            self._keep(side, ids, np.diff(at, prepend=0))
        rest = [c for c in chunks if c[0] not in b" \n" or c[-1] in b" \n"]
        if rest:
            raw = self._raw([c.decode() for c in rest])
            self._keep(rest, np.concatenate(raw), np.array([len(r) for r in raw]))

    def _places(self, distinct: list[bytes]) -> np.ndarray:
        place = self.place
        fresh = [c for c in distinct if c not in place]
        if self.n + len(fresh) > self.limit:
            self._clear()
            place, fresh = self.place, distinct
        if fresh:
            self._learn(fresh)
        return np.fromiter(map(place.__getitem__, distinct), np.int64, len(distinct))

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each text); nulls are empty texts."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        plain = [not (_ODD.search(t) or (self.special and self.special.search(t))) for t in texts.to_pylist()]
        if all(plain):
            return self._cut(texts)
        mask = np.array(plain)
        ids, sizes = self._cut(texts.filter(pa.array(mask)))
        whole = self._raw(texts.filter(pa.array(~mask)).to_pylist())
        count = np.zeros(len(texts), np.int64)
        count[mask], count[~mask] = sizes, [len(w) for w in whole]
        out, at = np.empty(count.sum(), "<u4"), np.repeat(mask, count)
        out[at] = ids
        out[~at] = np.concatenate(whole)
        return out, count

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        _, off, buf = texts.buffers()
        off = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        if off[-1] == off[0]:
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        gap = _BREAK[data]
        cut = np.zeros(len(data) + 1, bool)
        kind = _KIND[data]
        cut[1:-1] = gap[1:] & ~gap[:-1] | (kind[:-1] & 3 > 0) & (kind[1:] > 0) & (kind[:-1] != kind[1:])
        cut[off] = True
        cuts = np.flatnonzero(cut)
        if cuts[-1] < 1 << 31:
            chunks = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
        else:
            chunks = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        told = chunks.dictionary_encode()
        k = self._places(told.dictionary.to_pylist())[told.indices.to_numpy(zero_copy_only=False)]
        end = self.end[k]
        start = np.where(k > 0, self.end[k - 1], 0)
        size = end - start
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.arange(total[-1]) + np.repeat(start - total[:-1], size)]
        return ids, np.diff(total[np.searchsorted(cuts, off)])

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, count = self.flat(pa.array(texts, pa.large_string()))
        raw, at = ids.tobytes(), [0, *(4 * np.cumsum(count)).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
