"""Encoding of texts in parts that encode on their own, each different part once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from annalake.llm.shingles import EXACT, span_hashes, text_bytes

#: Parts whose ids a worker keeps; beyond that it starts anew.
KEPT_PARTS = 1 << 20
_AT_START = np.uint64(0x9E3779B97F4A7C15)


class PieceCache:
    """Keeps the ids of parts by a 64-bit hash of their bytes. A text's first
    part is kept apart, as it may be encoded in another way."""

    def __init__(self, dtype: type) -> None:
        self.dtype = dtype
        self._forget()

    def begins(self, data: np.ndarray, final: np.ndarray) -> np.ndarray:
        """Where a part begins, besides the start of a text. final: the texts' last bytes."""
        raise NotImplementedError

    def ids_of(self, parts: list[str], at_start: list[bool]) -> list[list[int]]:
        raise NotImplementedError

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, self.dtype), 0

    def _learn(self, hashes: np.ndarray, encoded: list[list[int]]) -> None:
        length = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter((i for ids in encoded for i in ids), self.dtype, int(length.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        first = self.used + np.cumsum(length) - length
        self.used += len(flat)
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.first, self.length = np.concatenate([self.first, first])[order], np.concatenate([self.length, length])[order]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and the bounds of each text's ids."""
        data, offsets = text_bytes(texts)
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(texts) + 1, np.int64)
        final = np.zeros(len(data), bool)
        final[offsets[1:][np.diff(offsets) > 0] - 1] = True
        begins = self.begins(data, final)
        opens = offsets[:-1][np.diff(offsets) > 0]
        begins[opens] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        opening = np.zeros(len(data), bool)
        opening[opens] = True
        opening = opening[starts]
        hashes = span_hashes(data, starts, ends, EXACT)
        hashes[opening] ^= _AT_START
        found, at, place = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > KEPT_PARTS:
            self._forget()
        slot = np.searchsorted(self.known, found)
        new = np.ones(len(found), bool)
        inside = slot < len(self.known)
        new[inside] = self.known[slot[inside]] != found[inside]
        if new.any():
            where = at[new]
            self._learn(found[new], self.ids_of([data[a:b].tobytes().decode("utf-8") for a, b in zip(starts[where], ends[where], strict=True)], opening[where].tolist()))
            slot = np.searchsorted(self.known, found)
        slot = slot[place]
        length = self.length[slot]
        total = np.concatenate([[0], np.cumsum(length)])
        flat = self.ids[np.repeat(self.first[slot] - total[:-1], length) + np.arange(total[-1])]
        return flat, total[np.searchsorted(starts, offsets)]
