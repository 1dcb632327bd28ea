"""Fill-in-the-middle: texts cut at two line boundaries and written with sentinels.

The boundaries of a text, code points before each one, are a compressed set in
the manner of roaring bitmaps: offsets with the same high 16 bits share a
container, which keeps the low bits as a sorted array, as a bitmap or as runs,
whatever is smallest. Cumulative cardinalities of the containers, one search in
them and a select inside one container answer "where does unit k end", which
is asked twice a text. Texts are independent of each other: one Arrow map over
the scan, no shuffle, whole texts.

Defined results: a NULL text is the empty text, which is plain; so is a text that
holds a sentinel. A NULL id is drawn for as if its digits were empty. Repeated rows
come out alike. Other columns are neither read nor kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from annalake.llm.common import arrow_batch, text_slices, texts_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bits of an offset that a container keeps.
LOW_BITS = 16
_LOW = 1 << LOW_BITS
_WORD_BITS = 64


@dataclass(frozen=True)
class ArrayContainer:
    """Few values: 16 bits each."""

    values: np.ndarray

    def select(self, k: int) -> int:
        return int(self.values[k])


@dataclass(frozen=True)
class BitmapContainer:
    """Many values: a bit for each possible one, and the ones before each word."""

    words: np.ndarray
    before: np.ndarray

    @staticmethod
    def of(values: np.ndarray) -> BitmapContainer:
        bits = np.zeros(_LOW, np.uint8)
        bits[values] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        return BitmapContainer(words, np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        left = int(self.words[word])
        for _ in range(k - int(self.before[word])):
            left &= left - 1
        return word * _WORD_BITS + (left & -left).bit_length() - 1


@dataclass(frozen=True)
class RunContainer:
    """Consecutive values: where runs start, and the values before each run."""

    starts: np.ndarray
    before: np.ndarray

    @staticmethod
    def of(values: np.ndarray) -> RunContainer:
        first = np.flatnonzero(np.diff(values.astype(np.int64), prepend=-2) != 1)
        return RunContainer(values[first], first)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


Container = ArrayContainer | BitmapContainer | RunContainer


def container_of(values: np.ndarray) -> Container:
    """The container that takes the fewest bytes for some sorted low halves."""
    runs = 1 + int(np.count_nonzero(np.diff(values.astype(np.int64)) != 1))
    array, bitmap, run = 2 * len(values), _LOW // 8, 4 * runs
    if run < min(array, bitmap):
        return RunContainer.of(values)
    return ArrayContainer(values) if array <= bitmap else BitmapContainer.of(values)


@dataclass(frozen=True)
class BoundarySet:
    """Sorted offsets without repetitions."""

    keys: np.ndarray
    containers: tuple[Container, ...]
    #: Offsets before each container, and all of them.
    before: np.ndarray

    @staticmethod
    def of(offsets: np.ndarray) -> BoundarySet:
        high = offsets >> LOW_BITS
        keys, first = np.unique(high, return_index=True)
        low = (offsets & (_LOW - 1)).astype(np.uint16)
        edges = np.append(first, len(offsets))
        parts = tuple(container_of(low[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True))
        return BoundarySet(keys, parts, edges)

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The offset with ``k`` smaller ones."""
        place = int(np.searchsorted(self.before, k, side="right")) - 1
        return (int(self.keys[place]) << LOW_BITS) + self.containers[place].select(k - int(self.before[place]))


def line_ends(text: str) -> np.ndarray:
    """Code points up to the end of each line; the last one may lack its line feed."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.flatnonzero(points == 10) + 1
    if len(points) and (not len(ends) or ends[-1] < len(points)):
        ends = np.append(ends, len(points))
    return ends


@dataclass(frozen=True)
class Cut:
    """A transformed text and how it was made; ``prefix`` and ``middle`` are None if plain."""

    n: int
    form: str
    output: str
    prefix: int | None = None
    middle: int | None = None


def draws(seed: int, doc_id: int | None) -> tuple[int, ...]:
    """Four numbers below 2^32 that depend on the seed and the id alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def transform(text: str, drawn: tuple[int, ...], rate: int = 100, spm_rate: int = 50) -> Cut:
    """``rate`` percent of texts are cut, ``spm_rate`` percent of those suffix first."""
    bounds = BoundarySet.of(line_ends(text))
    n = len(bounds)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or drawn[2] % 100 >= rate:
        return Cut(n, "plain", text)
    first, second = sorted((drawn[0] % (n + 1), drawn[1] % (n + 1)))
    a, b = (bounds.select(units - 1) if units else 0 for units in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if drawn[3] % 100 < spm_rate:
        return Cut(n, "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", a, b - a)
    return Cut(n, "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", a, b - a)


def restore(output: str, form: str) -> str:
    """The text that an output was made of. Its parts hold no sentinel, and a
    sentinel can't begin inside another one, so the first match is the right one."""
    if form == "plain":
        return output
    head, middle = output[len(PREFIX) :].split(MIDDLE, 1)
    if form == "psm":
        prefix, suffix = head.split(SUFFIX, 1)
    else:
        suffix, prefix = head.split(PREFIX, 1)
    return prefix + middle + suffix


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


_FIELDS = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string(), "restored": pa.string()}
_SQL_TYPES = {pa.int64(): "long", pa.string(): "string"}


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output and the text rebuilt from
    it, for each row of ``docs``; the last two as SHA-256 if ``digests``."""
    names = {"output": "output_sha256", "restored": "restored_sha256"} if digests else {}
    types = {names.get(c, c): t for c, t in _FIELDS.items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            ids = batch.column("doc_id").to_pylist()
            cuts = [transform(text, draws(seed, i), rate, spm_rate) for i, text in zip(ids, batch.column("text").to_pylist(), strict=True)]
            shown = _sha256 if digests else str
            columns = [ids, [c.n for c in cuts], [c.form for c in cuts], [c.prefix for c in cuts], [c.middle for c in cuts]]
            columns += [[shown(c.output) for c in cuts], [shown(restore(c.output, c.form)) for c in cuts]]
            yield arrow_batch(dict(zip(types, columns, strict=True)), types)

    return texts_of(docs, id_col, text_col).mapInArrow(run, ", ".join(f"{c} {_SQL_TYPES[t]}" for c, t in types.items()))


def oracle() -> str:
    """The registered query in SQL."""
    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT *, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS units,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM texts),
cut AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= 100 THEN 'plain'
         WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix
  FROM cut)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
    ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts"""
