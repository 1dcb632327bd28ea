"""Text quality as an ordinal grade: a cumulative-link (proportional odds) model.

All thresholds share one weight vector over hashed byte n-grams: the chance of
at most grade k is the logistic function of (threshold k - score). The expected
grade and the chance of reaching a given grade select texts. Thresholds stay in
order because each is the one before plus a positive gap.

The model is fitted to a bounded sample of the rated rows, ``SAMPLE`` rows with
the smallest hashed ids; weights have a fixed size, and every text is scored whole.

Defined results: a NULL or empty text has no features and gets the grade that
the thresholds alone say. Rows without a grade teach nothing; an id that is
rated several times counts with its lowest grade. Without at least two grades
every text is expected to have the one grade there is, or 0, and tail 0. Rows
that repeat are graded alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalake.llm.common import arrow_batch, text_slices, texts_of
from annalake.llm.shingles import text_bytes, words

#: Hashed features, and how long the n-grams are.
FEATURES, ORDERS = 1 << 12, (1, 2, 3)
SAMPLE = 4000
RIDGE, ROUNDS = 1e-5, 300
#: The chance of the selecting grade from which a text is selected.
SELECTED_FROM = 0.5


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of all that isn't 0: square roots of the shares of
    n-grams, and as the last feature of words that say the word before again."""
    data, offsets = text_bytes(texts)
    n = np.diff(offsets)
    text_of = np.repeat(np.arange(len(n)), n)
    left = np.repeat(offsets[1:], n) - np.arange(len(data))
    keys = []
    gram = np.zeros(len(data), np.uint32)
    for k in range(max(ORDERS)):
        shifted = np.zeros(len(data), np.uint32)
        shifted[: len(data) - k] = data[k:]
        gram = gram * np.uint32(257) + shifted + np.uint32(1)
        if k + 1 in ORDERS:
            mixed = (gram ^ (gram >> np.uint32(11))) * np.uint32(0x9E3779B1)
            keys.append((text_of * FEATURES + (mixed >> np.uint32(20)))[left > k])
    counts = np.bincount(np.concatenate(keys), minlength=len(n) * FEATURES)  # a slice has few texts
    found = np.flatnonzero(counts)
    text, feature = found // FEATURES, found % FEATURES
    value = np.sqrt(counts[found] / (n[text] * len(ORDERS)))
    own = words(texts)
    again = np.zeros(len(own.hashes), np.int64)
    again[1:] = own.hashes[1:] == own.hashes[:-1]
    again[own.first[:-1][own.counts > 0]] = 0
    total = np.concatenate([[0], np.cumsum(again)])
    repeated = total[own.first[1:]] - total[own.first[:-1]]
    which = np.flatnonzero(repeated)
    return np.append(text, which), np.append(feature, np.full(len(which), FEATURES)), np.append(value, np.sqrt(repeated[which] / own.counts[which]))


@dataclass(frozen=True)
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray
    #: In order; there is one more than thresholds.
    grades: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        text, feature, value = _features(texts)
        return np.bincount(text, weights=self.weights[feature] * value, minlength=len(texts))

    def reach(self, scores: np.ndarray) -> np.ndarray:
        """The chance of each grade but the lowest, or a higher one."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: np.ndarray) -> Ordinal:
    """Maximum likelihood with a ridge, by full-batch Adam. y: places in ``grades``."""
    k = len(grades) - 1
    share = np.clip(np.cumsum(np.bincount(y, minlength=k + 1))[:-1] / len(y), 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    w, free = np.zeros(x.shape[1], np.float64), np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    state, x = [np.zeros(len(w) + k), np.zeros(len(w) + k)], np.ascontiguousarray(x, np.float32)
    for t in range(1, ROUNDS + 1):
        gaps = np.exp(free[1:])
        theta = np.concatenate([[-50.0], free[0] + np.concatenate([[0], np.cumsum(gaps)]), [50.0]])
        score = (x @ w.astype(np.float32)).astype(np.float64)
        upper, lower = (1 / (1 + np.exp(-np.clip(theta[y + d] - score, -40, 40))) for d in (1, 0))
        p = np.maximum(upper - lower, 1e-12)
        up, low = upper * (1 - upper) / p, lower * (1 - lower) / p
        by_theta = np.bincount(y + 1, weights=up, minlength=k + 2) - np.bincount(y, weights=low, minlength=k + 2)
        by_theta = by_theta[1:-1] / len(y)
        gradient = np.concatenate([((low - up) / len(y)).astype(np.float32) @ x - RIDGE * w, [by_theta.sum()], [by_theta[i + 1 :].sum() * gaps[i] for i in range(k - 1)]])
        state = [0.9 * state[0] + 0.1 * gradient, 0.999 * state[1] + 0.001 * gradient**2]
        step = 0.1 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-8)
        w += step[: len(w)]
        free += step[len(w) :]
    return Ordinal(w, free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))]), grades)


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    """Learn from the rows of ``docs`` that ``ratings`` gives a grade."""
    rated = ratings.select(F.col(f"`{id_col}`").cast("long").alias("_id"), grade.cast("int").alias("grade")).where("_id IS NOT NULL AND grade IS NOT NULL")
    rated = rated.groupBy("_id").agg(F.min("grade").alias("grade"))
    rows = texts_of(docs, id_col, text_col)
    ids = rows.select(F.col("doc_id").alias("_id")).distinct()
    chosen = rated.join(ids, "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    learn = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).dropDuplicates(["doc_id"])  # at most SAMPLE rows

    def dense(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            table = np.zeros((len(batch), FEATURES + 1), np.float32)
            text, feature, value = _features(batch.column("text"))
            table[text, feature] = value
            yield arrow_batch({"grade": batch.column("grade"), "x": [row.tobytes() for row in table]}, {"grade": pa.int32(), "x": pa.binary()})

    found = learn.select("grade", "text").mapInArrow(dense, "grade int, x binary").toPandas()
    grades, y = np.unique(found["grade"].to_numpy(np.int64), return_inverse=True)
    if len(grades) < 2:
        return Ordinal(np.zeros(FEATURES + 1), np.zeros(0), grades if len(grades) else np.zeros(1, np.int64))
    return fit_ordinal(np.frombuffer(b"".join(found["x"]), np.float32).reshape(len(found), FEATURES + 1), y, grades)


def rate(docs: DataFrame, model: Ordinal, reach: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail (the chance of grade ``reach`` or a higher one), selected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = {"doc_id": pa.int64(), "expected_grade": pa.float64(), "tail": pa.float64(), "selected": pa.bool_()}

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        steps = np.diff(own.grades)
        place = int(np.searchsorted(own.grades, reach))
        for batch in text_slices(batches):
            chances = own.reach(own.scores(batch.column("text")))
            if place == 0:
                tail = np.ones(len(batch))
            elif place <= len(steps):
                tail = chances[:, place - 1]
            else:
                tail = np.zeros(len(batch))
            yield arrow_batch({"doc_id": batch.column("doc_id"), "expected_grade": own.grades[0] + chances @ steps, "tail": tail, "selected": tail >= SELECTED_FROM}, types)

    return texts_of(docs, id_col, text_col).mapInArrow(score, "doc_id long, expected_grade double, tail double, selected boolean")
