"""Scoring texts with a hidden Markov model over words, trained by Baum-Welch.

A text is its words, lower-cased in ASCII, and one end. A state emits a class,
the class emits the word: ``P(w | state) = B[state, class(w)] * P(w | class)``.
The class is a fixed function of the word (its first two and last three bytes
and its length, hashed), so ``B`` has a bounded size and is broadcast, while the
words and their exact counts are a table that grows with the corpus and is never
gathered in one place.

* Counts: one aggregation over all learning texts.
* Baum-Welch: learning texts are cut into windows of 64 tokens, each a sequence of
  its own. Every task runs the scaled forward and backward recursions over its windows and
  hands on expected counts in fixed point, so that their sum doesn't depend on the
  order of tasks. The first model is a clustering of a bounded sample of windows;
  everything after it uses all windows.
* Scores: the scaled forward recursion over whole texts. A text longer than a
  segment goes on with one transfer matrix a segment, which gives the same
  likelihood as one long recursion, without its many steps.
* Word counts reach the texts in two ways. A word that makes up ``1 / HEAD`` of all
  tokens or more is in a broadcast of at most ``HEAD`` words of at most 64 bytes.
  All other words, which hence can't be hot, meet their counts in a join, one row
  for each word and chunk of texts.

Defined results: a NULL or blank text is the end alone. Without learning texts
every class is as likely as the others and no token is known. Repeated rows are
scored alike, rows with a NULL id too (it counts as the empty text when learning
rows are chosen). Other columns are neither read nor kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalake.llm.common import arrow_batch, scratch, stored, text_slices, texts_of

#: Parameters of the model.
STATES = 8
CLASSES = 1 << 15
ITERATIONS = 5
#: Share of the corpus-wide distribution of classes in each state's.
SMOOTHING = 0.02
#: Tokens of a training window, and windows that meet in one recursion.
WINDOW = 64
WINDOWS_AT_ONCE = 2560
#: Pieces of the corpus that the first model is made of, and windows of each.
SEED_ROWS = 64
SEED_WINDOWS = 16
#: Bounds of the broadcast of frequent words.
HEAD = 1 << 16
HEAD_BYTES = 64
#: Tokens of a segment, and of a chunk of texts that is scored at once.
SEGMENT = 2048
CHUNK = 4 << 20
#: Steps between two rescalings of a transfer matrix.
_RESCALE = 8
#: Expected counts travel as multiples of 1 / _UNIT.
_UNIT = 1 << 20
#: Classes in a window; no more than its range.
_PACKED = np.dtype(np.uint16)


def is_learned(doc_id: Column) -> Column:
    """Rows that the query's model learns from. A NULL id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 != 2


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts in order, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.flatten()
    given = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(given.to_numpy(zero_copy_only=False))])
    ends = np.cumsum(pc.list_value_length(lists).to_numpy())
    counts = np.diff(before[np.concatenate([[0], ends]).astype(np.int64)])
    return flat.filter(given), counts


def classes_of(words: pa.Array, classes: int = CLASSES) -> np.ndarray:
    """The class of each of some distinct words, none of them empty."""
    words = pa.concat_arrays([words.cast(pa.binary())])
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"\0", np.uint8)
    start, stop = offsets[:-1], offsets[1:]
    length = stop - start
    key = np.minimum(length, 8).astype(np.uint64)
    for at in (start, np.minimum(start + 1, stop - 1), stop - 1, np.maximum(stop - 2, start), np.maximum(stop - 3, start)):
        key = key * np.uint64(256) + data[at]
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((key >> np.uint64(20)) % np.uint64(classes)).astype(np.int32)


def _sequences(values: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of consecutive texts with ``end`` after each text, and the new lengths."""
    return np.insert(values, np.cumsum(counts), end), counts + 1


# -- learning -----------------------------------------------------------------


def _count(batches: Iterable[pa.RecordBatch], classes: int) -> Iterator[pa.RecordBatch]:
    """word, class, n; the row without a word counts the ends."""
    schema = pa.schema({"word": pa.string(), "class": pa.int32(), "n": pa.int64()})
    held, size = [], 0

    def folded() -> pa.Table:
        return pa.concat_tables(held).group_by(["word", "class"]).aggregate([("n", "sum")]).rename_columns(["word", "class", "n"])

    for batch in text_slices(batches, 4 << 20):
        texts = batch.column("text")
        encoded = words_of(texts)[0].dictionary_encode()
        n = np.bincount(encoded.indices.to_numpy(), minlength=len(encoded.dictionary))
        words = pa.concat_arrays([encoded.dictionary.cast(pa.string()), pa.nulls(1, pa.string())])
        kinds = np.append(classes_of(encoded.dictionary, classes), classes)
        held.append(pa.table([words, pa.array(kinds, pa.int32()), pa.array(np.append(n, len(texts)), pa.int64())], schema=schema))
        size += len(words)
        if size > 1 << 20:
            held = [folded()]
            size = held[0].num_rows
            if size > 1 << 19:
                yield from held[0].to_batches()
                held, size = [], 0
    if held:
        yield from folded().to_batches()


def _packed(batches: Iterable[pa.RecordBatch], classes: int) -> Iterator[pa.RecordBatch]:
    """The classes of some learning texts a row; an end tells where a text stops."""
    for batch in text_slices(batches):
        words, counts = words_of(batch.column("text"))
        values, _ = _sequences(classes_of(words, classes), counts, classes)
        yield pa.RecordBatch.from_arrays([pa.array([values.astype(_PACKED).tobytes()], pa.binary())], names=["classes"])


def windows_of(values: np.ndarray, end: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the windows of packed texts."""
    stops = np.flatnonzero(values == end) + 1
    if not len(stops) or stops[-1] < len(values):
        stops = np.append(stops, len(values))
    lengths = np.diff(stops, prepend=0)
    pieces = -(-lengths // window)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(stops - lengths, pieces) + nth * window
    return starts, np.minimum(window, np.repeat(stops, pieces) - starts)


@dataclass(frozen=True)
class Chain:
    """Start, transition and emission probabilities; a row of ``emission`` for each state."""

    start: np.ndarray
    move: np.ndarray
    emission: np.ndarray

    def expected(self, values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, moves and emissions of some windows, and their log likelihood."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")
        at = np.concatenate([[0], np.cumsum(active)])
        seen = np.concatenate([values[starts[:m] + t] for t, m in enumerate(active)])
        emission, move = self.emission.astype(np.float32), self.move.astype(np.float32)
        onto = np.ascontiguousarray(move.T)
        emitted = np.take(emission, seen, axis=1)
        forward, scale = np.empty_like(emitted), np.empty(len(seen), np.float32)
        state = self.start.astype(np.float32)[:, None]
        for t, m in enumerate(active):
            part = slice(at[t], at[t + 1])
            state = (state if t == 0 else onto @ state[:, :m]) * emitted[:, part]
            total = state.sum(axis=0)
            state /= total
            forward[:, part], scale[part] = state, total
        moves = np.zeros_like(self.move)
        gamma = forward.copy()
        later = np.ones((len(move), len(starts)), np.float32)
        for t in range(len(active) - 1, 0, -1):
            m, part = active[t], slice(at[t], at[t + 1])
            gamma[:, part] *= later[:, :m]
            onward = emitted[:, part] * later[:, :m]
            onward /= scale[part]
            moves += forward[:, at[t - 1] : at[t - 1] + m] @ onward.T
            later[:, :m] = move @ onward
        gamma[:, : at[1]] *= later
        emissions = np.stack([np.bincount(seen, row, emission.shape[1]) for row in gamma])
        return gamma[:, : at[1]].sum(axis=1, dtype=float), moves * self.move, emissions, float(np.log(scale, dtype=float).sum())

    def log_likelihood(self, values: np.ndarray, lengths: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
        """Natural log likelihood of each of some consecutive sequences, none of them empty."""
        starts, onto = np.cumsum(lengths) - lengths, np.ascontiguousarray(self.move.T)
        order = np.argsort(-np.minimum(lengths, segment), kind="stable")
        first, size = starts[order], np.minimum(lengths, segment)[order]
        state, log = np.repeat(self.start[:, None], len(order), axis=1), np.zeros(len(order))
        for t in range(int(size[0])):
            m = int(np.searchsorted(-size, -t, side="left"))
            moved = (state[:, :m] if t == 0 else onto @ state[:, :m]) * np.take(self.emission, values[first[:m] + t], axis=1)
            total = moved.sum(axis=0)
            np.divide(moved, total, out=state[:, :m])
            log[:m] += np.log(total)
        back = np.argsort(order)
        state, log = state[:, back], log[back]
        # What is left of long texts: a transfer matrix for each further segment.
        further = np.maximum(-(-lengths // segment) - 1, 0)
        if further.any():
            owner = np.repeat(np.arange(len(lengths)), further)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(further) - further, further)
            begin = starts[owner] + (nth + 1) * segment
            matrix, gained = self._transfers(values, begin, np.minimum(segment, starts[owner] + lengths[owner] - begin))
            for n in range(int(further.max())):
                rows = np.flatnonzero(nth == n)
                who = owner[rows]
                moved = np.einsum("is,sij->js", state[:, who], matrix[rows])
                total = moved.sum(axis=0)
                state[:, who] = moved / total
                log[who] += np.log(total) + gained[rows]
        return log

    def _transfers(self, values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each segment the scaled product of its steps' matrices, and the log of the scale."""
        states = len(self.start)
        order = np.argsort(-size, kind="stable")
        first, size = begin[order], size[order]
        matrix, log = np.tile(np.eye(states), (len(order), 1, 1)), np.zeros(len(order))
        for t in range(int(size[0])):
            m = int(np.searchsorted(-size, -t, side="left"))
            matrix[:m] = (matrix[:m].reshape(-1, states) @ self.move).reshape(m, states, states) * self.emission[:, values[first[:m] + t]].T[:, None, :]
            if t % _RESCALE == _RESCALE - 1 or t == size[0] - 1:
                top = matrix[:m].max(axis=(1, 2))
                matrix[:m] /= top[:, None, None]
                log[:m] += np.log(top)
        back = np.argsort(order)
        return matrix[back], log[back]


def _first_chain(sample: list[np.ndarray], share: np.ndarray, states: int) -> Chain:
    """One state for each group of alike windows; a state likes to stay."""
    width = 1 << 12
    points = np.zeros((max(len(sample), 1), width), np.float32)
    for row, window in zip(points, sample):
        np.add.at(row, window % width, 1.0)
    points = np.sqrt(points)
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
    chosen, nearest = [0], points @ points[0]
    for _ in range(states - 1):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, points @ points[chosen[-1]])
    centres = points[chosen]
    for _ in range(10):
        group = (points @ centres.T).argmax(axis=1)
        centres = np.stack([points[group == k].sum(axis=0) if (group == k).any() else centres[k] for k in range(states)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    emission = np.empty((states, len(share)))
    for k in range(states):
        own = np.bincount(np.concatenate([w for w, g in zip(sample, group) if g == k] or [np.zeros(0, _PACKED)]), minlength=len(share))
        emission[k] = 0.5 * share + 0.5 * (own / own.sum() if own.sum() else share)
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9)
    return Chain(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emission)


def _maximised(found: pa.Table, share: np.ndarray, states: int, smoothing: float) -> Chain:
    """The model that expected counts ask for. Columns are classes, then the starts,
    then the moves out of each state."""
    table = np.zeros((states, len(share) + 1 + states))
    table[:, found["slot"].to_numpy()] = np.stack([found[f"s{k}"].to_numpy() for k in range(states)]) / _UNIT
    emission, start, move = table[:, : len(share)], table[:, len(share)] + 1, table[:, len(share) + 1 :].T + 0.1
    used = emission.sum(axis=1, keepdims=True)
    emission = np.where(used > 0, emission / np.maximum(used, 1e-9), share)
    return Chain(start / start.sum(), move / move.sum(axis=1, keepdims=True), (1 - smoothing) * emission + smoothing * share)


def baum_welch(packed: DataFrame, chain: Chain, share: np.ndarray, iterations: int, window: int = WINDOW, smoothing: float = SMOOTHING) -> Chain:
    """``iterations`` rounds over all texts of ``packed`` (classes). What reaches the
    driver in each is a row of expected counts for each class."""
    states, sc = len(chain.start), packed.sparkSession.sparkContext
    names = [f"s{k}" for k in range(states)]
    types = {"slot": pa.int32(), **{n: pa.int64() for n in names}}
    for _ in range(iterations):
        shared = sc.broadcast(chain)

        def expect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((states, len(share) + 1 + states))
            for batch in batches:
                for blob in batch.column("classes"):
                    values = np.frombuffer(blob.as_buffer(), _PACKED).astype(np.int64)
                    starts, lengths = windows_of(values, len(share) - 1, window)
                    for k in range(0, len(starts), WINDOWS_AT_ONCE):
                        some = slice(k, k + WINDOWS_AT_ONCE)
                        start, move, emission, _ = shared.value.expected(values, starts[some], lengths[some])
                        total += np.concatenate([emission, start[:, None], move.T], axis=1)
            fixed = np.rint(total * _UNIT).astype(np.int64)
            slots = np.flatnonzero(fixed.any(axis=0))
            yield arrow_batch({"slot": slots, **{n: fixed[k, slots] for k, n in enumerate(names)}}, types)

        parts = packed.mapInArrow(expect, ", ".join(["slot int", *[f"{n} long" for n in names]]))
        chain = _maximised(parts.groupBy("slot").agg(*[F.sum(n).alias(n) for n in names]).toArrow(), share, states, smoothing)
        shared.unpersist()
    return chain


@dataclass(frozen=True)
class LanguageModel:
    chain: Chain
    #: Exact counts of all words: word, class, n.
    counts: DataFrame
    #: Frequent words and their counts; all other words are looked up in ``counts``.
    head: pa.Table
    #: Learning tokens and their different ones, ends included; for each class too.
    tokens: int
    vocabulary: int
    class_size: np.ndarray
    #: Learning texts, the count of the end.
    texts: int


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    states: int = STATES,
    classes: int = CLASSES,
    iterations: int = ITERATIONS,
    window: int = WINDOW,
    head: int = HEAD,
) -> LanguageModel:
    """Learn from every row of ``docs``."""
    folder, texts = scratch(docs.sparkSession), texts_of(docs, id_col, text_col).select("text")
    parts = texts.mapInArrow(lambda batches: _count(batches, classes), "word string, class int, n long")
    counts = stored(parts.groupBy("word", "class").agg(F.sum("n").alias("n")), f"{folder}/counts")
    sizes = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("different")).toArrow()
    kind, n, different = (sizes[c].to_numpy() for c in ("class", "n", "different"))
    tokens, vocabulary = int(n.sum()), int(different.sum())
    occurrences, class_size = np.zeros(classes + 1), np.zeros(classes + 1)
    occurrences[kind], class_size[kind] = n, n + different
    share = (occurrences + 1) / (occurrences + 1).sum()
    frequent = counts.where(F.col("word").isNotNull() & (F.col("n") * head >= tokens) & (F.octet_length("word") <= HEAD_BYTES))
    packed = stored(texts.mapInArrow(lambda batches: _packed(batches, classes), "classes binary"), f"{folder}/classes")
    sample = []
    few = packed.select(F.xxhash64("classes").alias("drawn"), F.substring("classes", 1, SEED_WINDOWS * window * _PACKED.itemsize).alias("classes"))
    for blob in few.orderBy("drawn", "classes").limit(SEED_ROWS).toArrow()["classes"].to_pylist():
        values = np.frombuffer(blob, _PACKED)
        sample += [values[a : a + n] for a, n in zip(*windows_of(values, classes, window))][:SEED_WINDOWS]
    chain = baum_welch(packed, _first_chain(sample, share, states), share, iterations, window)
    return LanguageModel(chain, counts, frequent.select("word", "n").toArrow(), tokens, vocabulary, class_size, int(occurrences[classes]))


# -- scoring ------------------------------------------------------------------

_PARTS = {"chunk": pa.string(), "row": pa.int32(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "logs": pa.float64(), "hidden": pa.float64(), "word": pa.string(), "places": pa.list_(pa.int32())}
_PARTS_SQL = "chunk string, row int, doc_id long, n_tokens long, n_known long, logs double, hidden double, word string, places array<int>"


class _Chunk:
    """Texts that are scored at once: their classes, and the places of their rare words."""

    def __init__(self) -> None:
        self.ids, self.lengths, self.known, self.logs, self.kinds = [], [], [], [], []
        self.rare, self.places, self.texts, self.tokens = [], [], 0, 0

    def add(self, ids: pa.Array, texts: pa.Array, model: Scorer) -> None:
        words, counts = words_of(texts)
        owner = np.repeat(np.arange(len(texts)), counts)
        found = pc.index_in(words, model.head_words).fill_null(-1).to_numpy()
        self.known.append(np.bincount(owner, found >= 0, len(texts)).astype(np.int64) + (model.end_log > 0))
        self.logs.append(np.bincount(owner, model.head_logs[found], len(texts)) + model.end_log)
        values, lengths = _sequences(classes_of(words, model.classes), counts, model.classes)
        self.ids.append(ids)
        self.kinds.append(values)
        self.lengths.append(lengths)
        rare = found < 0
        self.rare.append(words.filter(pa.array(rare)))
        self.places.append((owner[rare] + self.texts).astype(np.int32))
        self.texts += len(texts)
        self.tokens += len(values)

    def rows(self, model: Scorer) -> Iterator[pa.RecordBatch]:
        name = uuid.uuid4().hex
        lengths, kinds = np.concatenate(self.lengths), np.concatenate(self.kinds)
        within = np.add.reduceat(model.class_logs[kinds], np.cumsum(lengths) - lengths)
        hidden = model.chain.log_likelihood(kinds, lengths) / np.log(10) - within
        ids = pa.concat_arrays(self.ids)
        columns = {"chunk": pa.repeat(name, len(ids)), "row": np.arange(len(ids)), "doc_id": ids, "n_tokens": lengths, "n_known": np.concatenate(self.known)}
        columns |= {"logs": np.concatenate(self.logs), "hidden": hidden, "word": pa.nulls(len(ids), pa.string()), "places": pa.nulls(len(ids), _PARTS["places"])}
        yield arrow_batch(columns, _PARTS)
        encoded = pa.concat_arrays(self.rare).dictionary_encode()
        codes, places = encoded.indices.to_numpy(), np.concatenate(self.places)
        order = np.argsort(codes, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(encoded.dictionary)))])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places[order], pa.int32()))
        for at in range(0, len(lists), 1 << 16):
            some = lists.slice(at, 1 << 16)
            none = {c: pa.nulls(len(some), t) for c, t in _PARTS.items()}
            yield arrow_batch({**none, "chunk": pa.repeat(name, len(some)), "word": encoded.dictionary.slice(at, 1 << 16).cast(pa.string()), "places": some}, _PARTS)


@dataclass(frozen=True)
class Scorer:
    """What of a model every task holds; its size is bounded by ``HEAD`` and the classes."""

    chain: Chain
    classes: int
    class_logs: np.ndarray
    head_words: pa.Array
    head_logs: np.ndarray
    end_log: float

    @staticmethod
    def of(model: LanguageModel) -> Scorer:
        logs = np.log10(model.head["n"].to_numpy().astype(float) + 1)
        class_logs = np.log10(model.class_size + 1)
        words = model.head["word"].combine_chunks()
        return Scorer(model.chain, len(model.class_size) - 1, class_logs, words, np.append(logs, 0.0), float(np.log10(model.texts + 1)))

    def parts(self, batches: Iterable[pa.RecordBatch], size: int = CHUNK) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk()
        for batch in text_slices(batches):
            chunk.add(batch.column("doc_id"), batch.column("text"), self)
            if chunk.tokens >= size:
                yield from chunk.rows(self)
                chunk = _Chunk()
        if chunk.texts:
            yield from chunk.rows(self)


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk, row, n, logs: what the rare words of some chunks add to their texts."""
    held: dict[str, list[np.ndarray]] = {}
    for batch in batches:
        chunks = batch.column("chunk").dictionary_encode()
        lists = batch.column("places")
        lengths = pc.list_value_length(lists).to_numpy()
        places = lists.flatten().to_numpy()
        count = np.repeat(batch.column("n").to_numpy(), lengths)
        owner = np.repeat(chunks.indices.to_numpy(), lengths)
        for k, name in enumerate(chunks.dictionary.to_pylist()):
            own = owner == k
            rows, size = places[own], int(places[own].max()) + 1
            n, logs = np.bincount(rows, minlength=size), np.bincount(rows, np.log10(count[own] + 1.0), size)
            old = held.get(name)
            if old is not None and len(old[0]) > size:
                n, logs = np.pad(n, (0, len(old[0]) - size)), np.pad(logs, (0, len(old[0]) - size))
            held[name] = [n, logs] if old is None else [n + np.pad(old[0], (0, len(n) - len(old[0]))), logs + np.pad(old[1], (0, len(n) - len(old[0])))]
    types = {"chunk": pa.string(), "row": pa.int32(), "n": pa.int64(), "more": pa.float64()}
    for name, (n, logs) in held.items():
        rows = np.flatnonzero(n)
        yield arrow_batch({"chunk": pa.repeat(name, len(rows)), "row": rows, "n": n[rows], "more": logs[rows]}, types)


def score(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of
    ``docs``. ``base_score`` is that of single words with one added to every count."""
    shared = docs.sparkSession.sparkContext.broadcast(Scorer.of(model))
    found = texts_of(docs, id_col, text_col).mapInArrow(lambda batches: shared.value.parts(batches), _PARTS_SQL)
    # Written once: chunks get their names here.
    parts = stored(found, f"{scratch(docs.sparkSession)}/parts")
    rare = parts.where("word IS NOT NULL").select("word", "chunk", "places")
    known = rare.join(model.counts.where("word IS NOT NULL").select("word", "n"), "word").select("chunk", "places", "n")
    sums = known.repartition("chunk").mapInArrow(_sums, "chunk string, row int, n long, more double")
    texts = parts.where("word IS NULL").select("chunk", "row", "doc_id", "n_tokens", "n_known", "logs", "hidden")
    joined = texts.join(sums, ["chunk", "row"], "left")
    logs = F.col("logs") + F.coalesce("more", F.lit(0.0))
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("n", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(model.tokens + model.vocabulary + 1)))).alias("base_score"),
        (logs + F.col("hidden")).alias("score"),
    )
