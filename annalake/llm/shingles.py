"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

Words are runs of bytes other than blank and 0x09-0x0D, with A-Z lower-cased.
In UTF-8 these bytes occur in no other character, so bytes give the same words
as characters. Hashes stand for words and shingles: within the pairs that are
compared, two different shingles fall together with a chance of about 2^-64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WIDTH = 5
_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def seeded(h: np.ndarray, seed: int) -> np.ndarray:
    return mix(h ^ _U(seed * 0xD1B54A32D192ED03 & _MASK))


EXACT = mix(np.arange(1, 257, dtype=_U) * _U(0x632BE59BD9B4E019))
_LOWERED = EXACT.copy()
_LOWERED[65:91] = _LOWERED[97:123]
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, *range(9, 14)]] = True
_POSITION = mix(np.arange(1, 65, dtype=_U)) | _U(1)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a slice of texts without NULLs, and the offsets of the texts in them."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _LOWERED) -> np.ndarray:
    """Hashes of data[start:end] for all spans at once, which mustn't overlap, from
    prefix sums. Every byte counts by a mixed value of its own for each place in its
    span; a polynomial modulo 2^64 would give some different spans one hash,
    whatever its base."""
    place = np.zeros(len(data), np.int64)
    place[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(place)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(mix(values[data] + place.astype(_U) * _U(_STEP)), out=total[1:])
    return mix(total[ends] - total[starts] + (ends - starts).astype(_U))


@dataclass(frozen=True)
class Words:
    """hashes: of all words in order. first: each text's first word, then the end."""

    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(texts: pa.Array, separator: np.ndarray = _SEPARATOR) -> Words:
    data, offsets = text_bytes(texts)
    if not len(data):
        return Words(np.zeros(0, _U), np.zeros(len(texts) + 1, np.int64))
    apart = separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(apart)
    before[0], before[1:] = True, apart[:-1]
    starts = np.flatnonzero(~apart & (before | edge[:-1]))
    after = np.empty_like(apart)
    after[-1], after[:-1] = True, apart[1:]
    ends = np.flatnonzero(~apart & (after | edge[1:])) + 1
    return Words(span_hashes(data, starts, ends), np.searchsorted(starts, offsets))


def shingles(found: Words, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts in order, repeats included, and each
    text's first one, then the end. A text with fewer words than the width has
    its whole sequence as one shingle, a text without words has none."""
    n, w = found.counts, found.hashes
    per_text = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(per_text)])
    if not len(w):
        return np.zeros(0, _U), first
    padded = np.concatenate([w, np.zeros(width, _U)])
    total = np.zeros(len(w), _U)
    for k in range(width):
        total += padded[k : k + len(w)] * _POSITION[k]
    at = np.arange(first[-1]) + np.repeat(found.first[:-1] - first[:-1], per_text)
    out = mix(total[at])
    for i in np.flatnonzero((n > 0) & (n < width)):
        own = w[found.first[i] : found.first[i + 1]]
        out[first[i]] = mix((own * _POSITION[: len(own)]).sum(keepdims=True) + _POSITION[width + len(own)])[0]
    return out, first


def sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    found, first = shingles(words(texts), width)
    return [np.unique(found[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def set_digest(one: np.ndarray) -> int:
    """A signed 64-bit name of a set; equal sets have equal names."""
    return int((mix(seeded(one, 1).sum(keepdims=True) + _U(len(one))).view(np.int64))[0])
