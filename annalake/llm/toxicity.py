"""Toxicity by class-conditional Kneser-Ney models over bytes.

Each class has interpolated Kneser-Ney orders of its own above ``SHARED``; at
that order both fall back to one model of the counts of both classes, so that
what is rare in either class weighs about the same in both. A text's figures
are length-normalised log-likelihood ratios: of the whole text, and the highest
of its windows of some widths. A logistic curve, fitted to figures that models
of one half of the learning rows give the other half, makes them a score.

All learning rows are counted. What is broadcast are those counts as sorted
n-grams, each with its own entry, so it grows with the number of different
n-grams and none falls together with another.

Defined results: a NULL or empty text has ratio 0 everywhere and is scored like
any other. Labels other than 0 and 1 teach nothing; an id with several labels
counts as toxic if one says so. Without learning rows of both classes every
score is 0. Rows that repeat are scored alike. Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalake.llm.common import arrow_batch, kept_rows, scratch, stored, text_slices, texts_of
from annalake.llm.shingles import text_bytes

#: Highest order, and the order up to which the classes share their counts.
ORDER, SHARED = 5, 2
DISCOUNT = 0.75
#: Bytes of the windows whose ratio is taken.
WINDOWS = (6, 12, 24, 96)
#: At most so many rows fit the curve: those with the smallest hashed ids.
CALIBRATION_ROWS = 20_000
THRESHOLD = 0.7
SLICE = 1 << 18
_HELD = 1 << 22  # n-grams a task holds before it adds them up
_PACKED = 1 << 18  # n-grams of one packed row
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[65:91] += 32
_BYTES[:33] = 32
_U = np.uint64


def _grams(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """At each byte the n-grams that end there, as integers, n from 1 to ORDER;
    then where texts start and end. A blank precedes every text."""
    raw, offsets = text_bytes(texts)
    n = np.diff(offsets) + 1
    ends = np.cumsum(n)
    starts = ends - n
    data = np.full(ends[-1] if len(ends) else 0, 32, np.uint8)
    inside = np.ones(len(data), bool)
    inside[starts] = False
    data[inside] = _BYTES[raw]
    place = np.arange(len(data)) - np.repeat(starts, n)
    grams, packed = [], np.zeros(len(data), _U)
    for k in range(ORDER):
        shifted = np.zeros(len(data), _U)
        shifted[k:] = data[: len(data) - k]
        shifted[place < k] = 0
        packed = packed | (shifted << _U(8 * k))
        grams.append(packed)
    return grams, starts, ends


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fold, label, gram, n) of the highest order, added up within the task."""
    held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0
    types = {"fold": pa.int32(), "label": pa.int32(), "gram": pa.int64(), "n": pa.int64()}

    def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return grams, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    def rows() -> Iterator[pa.RecordBatch]:
        for (fold, label), parts in held.items():
            grams, n = added(parts)
            for i in range(0, len(grams), 1 << 16):
                part = grams[i : i + (1 << 16)]
                yield arrow_batch({"fold": np.full(len(part), fold), "label": np.full(len(part), label), "gram": part.view(np.int64), "n": n[i : i + (1 << 16)]}, types)

    for batch in text_slices(batches):
        grams, starts, ends = _grams(batch.column("text"))
        key = np.array(batch.column("fold").to_pylist()) * 2 + np.array(batch.column("label").to_pylist())
        per_byte = np.repeat(key, ends - starts)
        for one in np.unique(key):
            found, n = np.unique(grams[-1][per_byte == one], return_counts=True)
            held.setdefault((int(one) // 2, int(one) % 2), []).append((found, n))
            size += len(found)
        if size > _HELD:
            held = {k: [added(parts)] for k, parts in held.items()}
            size = sum(len(parts[0][0]) for parts in held.values())
            if size > _HELD // 2:
                yield from rows()
                held, size = {}, 0
    yield from rows()


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams or contexts of a task by model, order, label and kind, as bytes:
    64-bit keys, counts, and followers of contexts."""
    types = {"model": pa.int32(), "order": pa.int32(), "label": pa.int32(), "context": pa.bool_(), "gram": pa.binary(), "n": pa.binary(), "kinds": pa.binary()}
    held: dict[tuple[int, int, int, bool], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for key, parts in held.items():
            whole = [np.concatenate(column).tobytes() for column in zip(*parts, strict=True)]
            yield arrow_batch({name: [value] for name, value in zip(types, [*key, *whole], strict=True)}, types)

    for batch in batches:
        columns = [np.array(batch.column(c)).astype(np.int64) for c in ("model", "order", "label", "context", "gram", "n", "kinds")]
        model, order, label, context = columns[:4]
        names, first, at = np.unique(((model * (ORDER + 1) + order) * 3 + label + 1) * 2 + context, return_index=True, return_inverse=True)
        for i, one in enumerate(first.tolist()):
            own = at == i if len(names) > 1 else slice(None)
            held.setdefault((int(model[one]), int(order[one]), int(label[one]), bool(context[one])), []).append(tuple(c[own] for c in columns[4:]))
        size += batch.num_rows
        if size > _PACKED:
            yield from rows()
            held, size = {}, 0
    yield from rows()


def _tables(counted: DataFrame, folder: str) -> DataFrame:
    """The tables of two models: 0 of the first half of the rows, 1 of all of them.

    Lower orders count the different n-grams that end in theirs, level by level;
    at ``SHARED`` the classes' n-grams become one."""
    both = counted.withColumn("model", F.explode(F.when(F.col("fold") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    level = both.groupBy("model", "label", "gram").agg(F.sum("n").alias("n"))
    placed = None
    for order in range(ORDER, 0, -1):
        level = stored(level, f"{folder}/order={order}")
        part = level.select("model", F.lit(order).alias("order"), "label", "gram", "n")
        placed = part if placed is None else placed.union(part)
        if order - 1 == SHARED:
            level = level.select("model", F.lit(-1).alias("label"), "gram").distinct()
        lower = F.col("gram").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))
        level = level.groupBy("model", "label", lower.alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    contexts = placed.groupBy("model", "order", "label", F.shiftrightunsigned("gram", 8).alias("gram")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
    both = placed.withColumn("kinds", F.lit(0)).withColumn("context", F.lit(False)).unionByName(contexts.withColumn("context", F.lit(True)))
    packed = both.mapInArrow(_pack, "model int, order int, label int, context boolean, gram binary, n binary, kinds binary")
    return stored(packed, f"{folder}/packed")


@dataclass(frozen=True)
class Level:
    """One order: sorted n-grams with their counts, and sorted contexts with 1 / sum
    and what goes to the lower order; a row for each class, one if they share. The
    last column is that of n-grams or contexts that were never seen."""

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    inverse: np.ndarray
    rest: np.ndarray


def _unpacked(rows: list, labels: tuple[int, ...], columns: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sorted keys of all labels, and a table of each column with a last 0."""
    read = {label: [np.frombuffer(b"".join(r[c] for r in rows if r["label"] == label), np.int64) for c in ("gram", *columns)] for label in labels}
    keys = np.unique(np.concatenate([found[0] for found in read.values()]))
    tables = [np.zeros((len(labels), len(keys) + 1)) for _ in columns]
    for i, label in enumerate(labels):
        at = np.searchsorted(keys, read[label][0])
        for table, values in zip(tables, read[label][1:], strict=True):
            table[i, at] = values
    return keys.view(_U), tables


def _slots(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the keys are, the last column for those that aren't there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, len(keys))


@dataclass(frozen=True)
class Models:
    levels: list[Level]

    @classmethod
    def of(cls, packed: DataFrame, model: int) -> Models:
        """One model's orders reach the driver one at a time; they grow with the different n-grams."""
        levels = []
        for order in range(1, ORDER + 1):
            labels = (-1,) if order <= SHARED else (0, 1)
            rows = packed.where((F.col("model") == model) & (F.col("order") == order)).collect()
            grams, (counts,) = _unpacked([r for r in rows if not r["context"]], labels, ("n",))
            contexts, (sums, kinds) = _unpacked([r for r in rows if r["context"]], labels, ("n", "kinds"))
            seen = sums > 0
            inverse = np.where(seen, 1 / np.where(seen, sums, 1), 0)
            rest = np.where(seen, DISCOUNT * kinds * inverse, 1)
            levels.append(Level(grams, counts.astype(np.float32), contexts, inverse.astype(np.float32), rest.astype(np.float32)))
        return cls(levels)

    def ratios(self, grams: list[np.ndarray]) -> np.ndarray:
        """At each byte log P(toxic) - log P(ordinary), computed once for each different n-gram."""
        top, at = np.unique(grams[-1], return_inverse=True)
        each = np.full((1, len(top)), 1 / 256, np.float32)
        for order, level in enumerate(self.levels, 1):
            gram = top & _U((1 << 8 * order) - 1)
            own, context = _slots(level.grams, gram), _slots(level.contexts, gram >> _U(8))
            each = np.maximum(level.counts[:, own] - np.float32(DISCOUNT), 0) * level.inverse[:, context] + level.rest[:, context] * each
        return (np.log(each[1]) - np.log(each[0]))[at]


def figures(models: Models, texts: pa.Array) -> np.ndarray:
    """For each text the mean ratio, and the highest mean of the windows of each width."""
    grams, starts, ends = _grams(texts)
    if not len(starts):
        return np.zeros((0, 1 + len(WINDOWS)))
    total = np.concatenate([[0.0], np.cumsum(models.ratios(grams), dtype=np.float64)])
    whole, length = total[ends] - total[starts], ends - starts
    out = [whole / length]
    for width in WINDOWS:
        sums = np.full(len(total), -np.inf)
        inside = max(len(total) - width, 0)
        sums[:inside] = total[width:] - total[:inside]
        last = np.maximum(ends - width + 1, starts + 1)
        edges = np.stack([starts, last], axis=1).ravel()
        best = np.maximum.reduceat(sums, edges)[::2]
        out.append(np.where(length >= width, best, whole) / width)
    out = np.stack(out, axis=1)
    out[length == 1] = 0
    return out


@dataclass(frozen=True)
class Curve:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, found: np.ndarray) -> np.ndarray:
        linear = np.clip(np.column_stack([np.ones(len(found)), (found - self.mean) / self.scale]) @ self.weights, -50, 50)
        return 1 / (1 + np.exp(-linear))


def fit_curve(found: np.ndarray, label: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> Curve:
    """Logistic regression by Newton's method."""
    mean, scale = found.mean(axis=0), found.std(axis=0) + 1e-9
    x = np.column_stack([np.ones(len(found)), (found - mean) / scale])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * found.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (label - p) - penalty @ w)
        w = w + np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return Curve(mean, scale, w)


def _scored(rows: DataFrame, models: Models, more: str) -> DataFrame:
    """``more`` (a long column) and the figures of each row's text."""
    shared = rows.sparkSession.sparkContext.broadcast(models)
    width = 1 + len(WINDOWS)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, SLICE):
            found = figures(shared.value, batch.column("text"))
            yield arrow_batch({more: batch.column(more), **{f"f{i}": found[:, i] for i in range(width)}}, {more: pa.int64(), **{f"f{i}": pa.float64() for i in range(width)}})

    return rows.select(F.col(more).cast("long").alias(more), "text").mapInArrow(score, f"{more} long, " + ", ".join(f"f{i} double" for i in range(width)))


@dataclass(frozen=True)
class Toxicity:
    models: Models | None
    curve: Curve | None


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Toxicity:
    """Learn from the rows of ``docs`` that ``labels`` marks. The halves are dealt by a hash of the id."""
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label IN (0, 1)").groupBy("_id").agg(F.max("label").alias("label"))
    # Labels grow with the texts: the same join whatever their number.
    rows = texts_of(docs, id_col, text_col).join(marks.hint("merge"), F.col("doc_id") == F.col("_id"))
    folder = scratch(docs.sparkSession)
    learn = stored(rows.select("doc_id", "text", "label", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold")), f"{folder}/learn")
    counted = stored(learn.select("fold", "label", "text").mapInArrow(_count, "fold int, label int, gram long, n long").groupBy("fold", "label", "gram").agg(F.sum("n").alias("n")), f"{folder}/counted")
    if learn.select("label").distinct().count() < 2:
        return Toxicity(None, None)
    dense = _tables(counted, f"{folder}/levels")
    other = learn.where("fold = 1").withColumn("key", F.xxhash64("doc_id", F.lit(1)))
    last = other.select("key").orderBy("key").limit(CALIBRATION_ROWS).agg(F.max("key")).first()[0]
    sample = other.where(F.col("key") <= F.lit(last)).select("text", F.col("label").cast("long").alias("label"))
    scored = _scored(sample, Models.of(dense, 0), "label").toArrow()
    found = np.column_stack([np.array(c, np.float64) for c in scored.columns])
    if len(np.unique(found[:, 0])) < 2:
        return Toxicity(None, None)
    return Toxicity(Models.of(dense, 1), fit_curve(found[:, 1:], found[:, 0]))


def detect(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for each row of ``docs``."""
    rows = texts_of(docs, id_col, text_col)
    if model.models is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    curve = docs.sparkSession.sparkContext.broadcast(model.curve)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.column_stack([np.array(batch.column(c)) for c in batch.schema.names[1:]])
            scores = curve.value.score(found)
            yield arrow_batch({"doc_id": batch.column(0), "score": scores, "predicted": (scores >= THRESHOLD).astype(np.int32)}, {"doc_id": pa.int64(), "score": pa.float64(), "predicted": pa.int32()})

    return _scored(rows, model.models, "doc_id").mapInArrow(score, "doc_id long, score double, predicted int")


def clean(docs: DataFrame, model: Toxicity, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't predicted to be toxic, with all their columns."""
    if model.models is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return kept_rows(docs, text_col, lambda texts: shared.value.curve.score(figures(shared.value.models, texts)) < THRESHOLD, SLICE)
