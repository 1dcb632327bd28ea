"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are gathered from all learning rows by one aggregation; the matrix of
log probabilities has ``buckets`` rows and a column for each language and is
broadcast. Batches are scored in numpy, a gather and a segmented sum for each
language.

Defined results: a NULL text or one without a letter is ``und`` with score 0.
So is every text if nothing can be learned. Rows with a NULL language teach
nothing. Repeated rows are scored alike. Equal likelihoods go to the language
that sorts first. Texts are taken whole, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalake.llm.common import arrow_batch, kept_rows, text_slices, texts_of

UNDETERMINED = "und"
#: Size of the hashed feature space; with the languages it bounds the broadcast.
BUCKETS = 1 << 16
MAX_LANGUAGES = 1000
ORDERS = (1, 2, 3)
#: Added to every count.
SMOOTHING = 0.5
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return _ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text))


def _features(texts: list[str], buckets: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the bucket at each position, and where texts start and end.
    Every text has a space before and after it."""
    padded = [f" {t.lower()} " for t in texts]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    ends = np.cumsum(lengths)
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    found, key = [], np.zeros(len(points), np.uint32)
    for n in ORDERS:
        shifted = np.zeros_like(points)
        shifted[: len(points) - n + 1] = points[n - 1 :]
        key = key * np.uint32(0x01000193) + shifted * np.uint32(0x9E3779B1) + np.uint32(n)
        mixed = key ^ (key >> np.uint32(15))
        mixed = mixed * np.uint32(0x2C1B3C6D)
        found.append(((mixed ^ (mixed >> np.uint32(13))) & np.uint32(buckets - 1)).astype(np.int32))
    return found, ends - lengths, ends


def _segment_sums(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Sum of values[start:stop] for each segment, 0 for an empty one."""
    padded = np.append(values, values.dtype.type(0))
    edges = np.stack([starts, np.maximum(stops, starts)], axis=1).ravel()
    return np.where(stops > starts, np.add.reduceat(padded, edges)[::2], 0)


def _count(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in text_slices(batches):
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        features, starts, ends = _features(batch.column("text").to_pylist(), buckets)
        length = len(features[0])
        for lang in sorted(set(langs)):
            own = langs == lang
            total = counts.setdefault(lang, np.zeros(buckets, np.int64))
            rows[lang] = rows.get(lang, 0) + int(own.sum())
            for n, feature in zip(ORDERS, features, strict=True):
                stops = ends - n + 1
                edges = np.zeros(length + 2, np.int32)
                keep = own & (stops > starts)
                np.add.at(edges, starts[keep], 1)
                np.add.at(edges, stops[keep], -1)
                total += np.bincount(feature[np.cumsum(edges)[:length] > 0], minlength=buckets)
    types = {"lang": pa.string(), "bucket": pa.int32(), "n": pa.int64()}
    for lang, total in counts.items():
        used = np.flatnonzero(total)
        yield arrow_batch({"lang": [lang] * (len(used) + 1), "bucket": np.append(used, -1), "n": np.append(total[used], rows[lang])}, types)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: A row for each language.
    log_probability: np.ndarray
    log_prior: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        features, starts, ends = _features(texts, self.log_probability.shape[1])
        likelihood = np.tile(self.log_prior, (len(texts), 1))
        for k, row in enumerate(self.log_probability):
            for n, feature in zip(ORDERS, features, strict=True):
                likelihood[:, k] += _segment_sums(row[feature], starts, ends - n + 1)
        best = likelihood.argmax(axis=1)
        score = 1 / np.exp(likelihood - likelihood.max(axis=1, keepdims=True)).sum(axis=1)
        known = np.fromiter(map(has_letter, texts), bool, len(texts))
        return [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, known, strict=True)], np.where(known, score, 0.0)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS) -> LanguageModel:
    """Learn from every row of ``docs`` that has a language. What reaches the
    driver are at most languages x buckets counts."""
    learn = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("lang IS NOT NULL")
    parts = learn.mapInArrow(lambda batches: _count(batches, buckets), "lang string, bucket int, n long")
    found = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = tuple(sorted(found["lang"].unique().to_pylist()))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; the broadcast matrix is bounded by {MAX_LANGUAGES}")
    counts, rows = np.zeros((len(languages), buckets)), np.zeros(len(languages))
    place = pc.index_in(found["lang"], pa.array(languages, pa.string())).to_numpy()
    bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    marks = bucket < 0
    rows[place[marks]] = n[marks]
    counts[place[~marks], bucket[~marks]] = n[~marks]
    smoothed = counts + SMOOTHING
    log_probability = np.log(smoothed / smoothed.sum(axis=1, keepdims=True)).astype(np.float32)
    return LanguageModel(languages, log_probability, np.log(np.maximum(rows, 1) / max(rows.sum(), 1)))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the posterior) for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = {"doc_id": pa.int64(), "lang_pred": pa.string(), "score": pa.float64()}

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            yield arrow_batch({"doc_id": batch.column("doc_id"), "lang_pred": names, "score": scores}, types)

    return texts_of(docs, id_col, text_col).mapInArrow(score, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, model: LanguageModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that have a language, with a posterior of ``least`` or more, and all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: pa.Array) -> np.ndarray:
        names, scores = shared.value.predict(texts.to_pylist())
        return (np.array(names, dtype=object) != UNDETERMINED) & (scores >= least)

    return kept_rows(docs, text_col, keep)
