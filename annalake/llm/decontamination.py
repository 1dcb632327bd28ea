"""Benchmark decontamination by SimHash over item-sized windows.

A window has as many words as the item it is held against. Its fingerprint adds
up its five-word shingles, each as often as it occurs, and keeps 64 signs.
Candidates within the radius are then compared exactly, by the weighted Jaccard
similarity of the two multisets of shingles. A pair of that similarity is lost
if its fingerprints are further apart; the radius makes that rare (README).

Only windows with enough shingles of items to reach the similarity are
fingerprinted: what no item has can't be shared. Their fingerprints are held
against those of all items of their length, as blocks of a few bits, which so
wide a radius needs, would leave out next to none. Items are the stated query
set; they go to the tasks in blocks of bounded size, and the table of documents
is read once a block.

Words are runs of letters and digits (ASCII) or characters beyond ASCII, with
A-Z lower-cased, so punctuation doesn't hide a passage. Defined results: NULL or
empty texts and items without words match nothing. A text or item with fewer
words than a shingle has its whole sequence as one; an item longer than a text
is held against the whole text. Rows that repeat are matched alike. Among the
windows of equal similarity the first one is given.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalake.llm.common import arrow_batch, kept_rows, text_slices, texts_of
from annalake.llm.shingles import WIDTH, seeded, shingles, words

BITS, RADIUS = 64, 22
SIMILARITY = 0.8
#: Characters of items that travel at once.
ITEM_CHARS = 32_000_000
#: Pairs of fingerprints that are compared at once.
_TILE = 1 << 20
_U = np.uint64
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SHIFTS = np.arange(BITS, dtype=_U)


def sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of all texts in order, each text's first, and the counts of words."""
    found = words(texts, _SEPARATOR)
    own, first = shingles(found, WIDTH)
    return own, first, found.counts


def signs(own: np.ndarray) -> np.ndarray:
    """+1 or -1 for each shingle and bit."""
    return ((seeded(own, 5)[:, None] >> _SHIFTS) & _U(1)).astype(np.int32) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(_U) << _SHIFTS).sum(axis=1, dtype=_U)


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard of two multisets of shingles."""
    names, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = np.bincount(at[: len(x)], minlength=len(names)), np.bincount(at[len(x) :], minlength=len(names))
    return float(np.minimum(a, b).sum() / np.maximum(a, b).sum()) if len(names) else 0.0


@dataclass(frozen=True)
class Items:
    """Items with the same number of shingles."""

    numbers: np.ndarray
    fingerprints: np.ndarray

    @classmethod
    def of(cls, numbers: list[int], own: list[np.ndarray]) -> Items:
        prints = np.concatenate([_fingerprints(signs(s).sum(axis=0, keepdims=True)) for s in own])
        return cls(np.array(numbers), prints)

    def near(self, fingerprints: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(fingerprint's place, item's place, distance) of all pairs within the radius."""
        step = max(1, _TILE // len(self.numbers))
        for first in range(0, len(fingerprints), step):
            distance = np.bitwise_count(fingerprints[first : first + step, None] ^ self.fingerprints)
            for window, item in np.argwhere(distance <= RADIUS).tolist():
                yield first + window, item, int(distance[window, item])


class Index:
    """Items by their number of shingles, and which shingles occur in any."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        own, first, self.n_words = sequences(pa.array([text for _, text in items], pa.string()))
        self.ids = [i for i, _ in items]
        self.shingles = [own[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        by_length: dict[int, list[int]] = defaultdict(list)
        for i, one in enumerate(self.shingles):
            if len(one):
                by_length[len(one)].append(i)
        self.groups = {n: Items.of(numbers, [self.shingles[i] for i in numbers]) for n, numbers in by_length.items()}
        self.longest = max(self.groups, default=0)
        self.any = np.unique(own)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.any >> _U(44)).astype(np.int64)] = True
        lengths: dict[int, set[int]] = defaultdict(set)
        for n, numbers in by_length.items():
            for i in numbers:
                for s in set(self.shingles[i].tolist()):
                    lengths[s].add(n)
        self.lengths = {s: sorted(n) for s, n in lengths.items()}

    def anchors(self, own: np.ndarray) -> np.ndarray:
        """Places of shingles that occur in an item."""
        at = np.flatnonzero(self.sieve[(own >> _U(44)).astype(np.int64)])
        if not len(at) or not len(self.any):
            return at[:0]
        slot = np.minimum(np.searchsorted(self.any, own[at]), len(self.any) - 1)
        return at[self.any[slot] == own[at]]

    def matches(self, own: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(item, first shingle, distance, similarity) of the best window for each
        item that one text's shingles match. at: the text's anchors."""
        starts: dict[int, set[int]] = defaultdict(set)
        for place in at.tolist():
            for n in self.lengths[int(own[place])]:
                starts[n].update(range(max(0, place - n + 1), min(place, max(len(own) - n, 0)) + 1))
        best: dict[int, tuple[float, int, int]] = {}
        anchors = np.zeros(len(own) + 1, np.int64)
        anchors[at + 1] = 1
        np.cumsum(anchors, out=anchors)
        for n, wanted in starts.items():
            first = np.array(sorted(wanted))
            stop = np.minimum(first + n, len(own))
            # Shared shingles s of a and b have similarity s / (a + b - s).
            first = first[anchors[stop] - anchors[first] >= SIMILARITY / (1 + SIMILARITY) * (stop - first + n) - 1e-9]
            if not len(first):
                continue
            for lump in np.split(first, np.flatnonzero(np.diff(first) > n) + 1):
                region = own[lump[0] : lump[-1] + n]
                total = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(signs(region), axis=0, dtype=np.int32)])
                stop = np.minimum(lump + n, len(own))
                prints = _fingerprints(total[stop - lump[0]] - total[lump - lump[0]])
                group = self.groups[n]
                for window, item, distance in group.near(prints):
                    number, start = int(group.numbers[item]), int(lump[window])
                    alike = similarity(own[start : stop[window]], self.shingles[number])
                    if alike >= SIMILARITY and (number not in best or (-alike, start) < (-best[number][0], best[number][1])):
                        best[number] = alike, start, distance
        for number, (alike, start, distance) in sorted(best.items()):
            yield number, start, distance, alike


def _anchored(texts: pa.Array, index: Index) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Of texts with a shingle of any item: place, shingles, anchors, number of words."""
    own, first, n_words = sequences(texts)
    hits = index.anchors(own)
    text_of = np.searchsorted(first, hits, side="right") - 1
    for text in np.unique(text_of).tolist():
        a, b = first[text], first[text + 1]
        yield text, own[a:b], hits[text_of == text] - a, int(n_words[text])


def _match(batches: Iterable[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    types = {"doc_id": pa.int64(), "item_id": pa.int64(), "first_word": pa.int64(), "n_words": pa.int64(), "distance": pa.int32(), "similarity": pa.float64()}
    for batch in text_slices(batches):
        rows = []
        for text, own, at, n_words in _anchored(batch.column("text"), index):
            for number, start, distance, alike in index.matches(own, at):
                rows.append((batch.column("doc_id")[text].as_py(), index.ids[number], start, min(int(index.n_words[number]), n_words - start), distance, alike))
        if rows:
            yield arrow_batch(dict(zip(types, map(list, zip(*rows, strict=True)), strict=True)), types)


def _indexes(benchmark: DataFrame, item_id_col: str, item_text_col: str) -> Iterator[Broadcast]:
    items = texts_of(benchmark, item_id_col, item_text_col).where("text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = chars // ITEM_CHARS + 1
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)) == block).distinct().orderBy("doc_id", "text").collect()  # bounded by ITEM_CHARS
        yield benchmark.sparkSession.sparkContext.broadcast(Index([(r["doc_id"], r["text"]) for r in own]))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, first_word, n_words, distance, similarity of every item
    that a text has: its most similar window."""
    schema = "doc_id long, item_id long, first_word long, n_words long, distance int, similarity double"
    found = None
    for index in _indexes(benchmark, item_id_col, item_text_col):
        part = texts_of(docs, id_col, text_col).mapInArrow(lambda batches, index=index: _match(batches, index.value), schema)
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that have no item of the benchmark, with all their columns."""
    for index in _indexes(benchmark, item_id_col, item_text_col):

        def keep(texts: pa.Array, index: Broadcast = index) -> np.ndarray:
            mask = np.ones(len(texts), bool)
            for text, own, at, _ in _anchored(texts, index.value):
                mask[text] = next(index.value.matches(own, at), None) is None
            return mask

        docs = kept_rows(docs, text_col, keep)
    return docs
