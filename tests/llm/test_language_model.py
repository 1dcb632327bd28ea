"""The hidden Markov model against enumeration of state paths and plain counting."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests_llm_common import ascii_lower, sentence

from annalake.llm import hidden_markov as hm

STATES, CLASSES = 3, 5


def chain(seed=1, states=STATES, classes=CLASSES):
    rng = np.random.default_rng(seed)
    parts = [rng.random(s) + 0.05 for s in (states, (states, states), (states, classes + 1))]
    return hm.Chain(*[p / p.sum(axis=-1, keepdims=True) for p in parts])


def plain_forward(model, values):
    log, state = 0.0, model.start * model.emission[:, values[0]]
    for v in values[1:]:
        log += math.log(state.sum())
        state = (state / state.sum()) @ model.move * model.emission[:, v]
    return log + math.log(state.sum())


def test_likelihood_of_whole_sequences_equals_all_paths():
    model, rng = chain(), np.random.default_rng(2)
    lengths = np.array([1, 4, 7, 2, 6])
    values = rng.integers(0, CLASSES + 1, lengths.sum())
    expected = []
    for one in np.split(values, np.cumsum(lengths)[:-1]):
        total = 0.0
        for path in itertools.product(range(STATES), repeat=len(one)):
            p = model.start[path[0]] * model.emission[path[0], one[0]]
            for a, b, v in zip(path, path[1:], one[1:]):
                p *= model.move[a, b] * model.emission[b, v]
            total += p
        expected.append(math.log(total))
    for segment in (1, 2, 3, 100):
        assert np.allclose(model.log_likelihood(values, lengths, segment), expected, rtol=1e-12)


def test_segments_of_long_sequences_equal_one_recursion():
    model, rng = chain(3), np.random.default_rng(4)
    lengths = np.array([5000, 1, 700, 2049, 64])
    values = rng.integers(0, CLASSES + 1, lengths.sum())
    expected = [plain_forward(model, one) for one in np.split(values, np.cumsum(lengths)[:-1])]
    for segment in (64, 701, 2048, 10_000):
        assert np.allclose(model.log_likelihood(values, lengths, segment), expected, rtol=1e-10)


def test_expected_counts_equal_all_paths():
    model, rng = chain(5), np.random.default_rng(6)
    lengths = np.array([3, 1, 5])
    values = rng.integers(0, CLASSES + 1, lengths.sum())
    starts, moves, emissions = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES + 1))
    for one in np.split(values, np.cumsum(lengths)[:-1]):
        paths = {}
        for path in itertools.product(range(STATES), repeat=len(one)):
            p = model.start[path[0]] * model.emission[path[0], one[0]]
            for a, b, v in zip(path, path[1:], one[1:]):
                p *= model.move[a, b] * model.emission[b, v]
            paths[path] = p
        total = sum(paths.values())
        for path, p in paths.items():
            starts[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / total
            for s, v in zip(path, one):
                emissions[s, v] += p / total
    found = model.expected(values, np.cumsum(lengths) - lengths, lengths)
    for a, b in zip(found, (starts, moves, emissions)):
        assert np.allclose(a, b, atol=1e-4)


def test_windows_cover_every_token_once():
    values = np.array([1, 2, 9, 9, 3, 4, 5, 6, 7, 9, 8])
    starts, lengths = hm.windows_of(values, 9, 2)
    assert [values[a : a + n].tolist() for a, n in zip(starts, lengths)] == [[1, 2], [9], [9], [3, 4], [5, 6], [7, 9], [8]]


def test_words_are_split_at_ascii_spaces_only():
    texts = ["A b\x0bc\x0c d\r\n", "", " \t ", "Ä　é\x85x\x1cy É", "\x00 z"]
    words, counts = hm.words_of(pa.array(texts))
    expected = [ascii_lower(t).encode().split() for t in texts]
    assert [w.as_buffer().to_pybytes() for w in words] == [w for e in expected for w in e]
    assert counts.tolist() == [len(e) for e in expected]


def corpus(n=300):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        words = sentence(rng, rng.randrange(1, 60)).split()
        if i % 2:
            words = [w[::-1] for w in words]
        if i % 5 == 0:
            words.append(f"rare{i}")
        rows.append((i, " ".join(words).title() if i % 3 else " ".join(words)))
    return [*rows, (n, None), (n + 1, " \n "), (n + 2, rows[0][1]), (n + 2, rows[0][1])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id bigint, text string").cache()


@pytest.mark.parametrize("head", [1, 50, 1 << 16])
def test_scores_equal_plain_python(docs, head):
    """However few words are in the broadcast."""
    model = hm.fit(docs.where(hm.is_learned(F.col("doc_id"))), states=3, classes=64, iterations=2, head=head)
    assert head > 1 or model.head.num_rows == 0
    counts, texts = Counter(), 0
    for i, text in corpus():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(ascii_lower(text or "").encode().split())
            texts += 1
    n, v = sum(counts.values()) + texts, len(counts) + 1
    assert (model.tokens, model.vocabulary, model.texts) == (n, v, texts)
    assert {r.word.encode(): r.n for r in model.counts.where("word IS NOT NULL").collect()} == counts
    sizes = Counter()
    for w, c in counts.items():
        sizes[int(hm.classes_of(pa.array([w]), 64)[0])] += c + 1
    expected = []
    for i, text in corpus():
        words = ascii_lower(text or "").encode().split()
        kinds = [int(hm.classes_of(pa.array([w]), 64)[0]) for w in words] + [64]
        logs = [math.log10(counts[w] + 1) for w in words] + [math.log10(texts + 1)]
        within = sum(math.log10(sizes[k] + 1) for k in kinds[:-1]) + math.log10(texts + 2)
        score = plain_forward(model.chain, kinds) / math.log(10) + sum(logs) - within
        expected.append((i, len(kinds), sum(w in counts for w in words) + 1, n, sum(logs) - len(kinds) * math.log10(n + v + 1), score))
    found = sorted(map(tuple, hm.score(docs, model).collect()))
    assert [r[:4] for r in found] == [r[:4] for r in sorted(expected)]
    assert np.allclose([r[4:] for r in found], [r[4:] for r in sorted(expected)], rtol=1e-9)


def test_training_climbs_and_beats_single_words(docs):
    logs = []
    for iterations in (0, 1, 4):
        model = hm.fit(docs, states=4, classes=256, iterations=iterations)
        rows = hm.score(docs, model).collect()
        logs.append(sum(r.score for r in rows))
    assert logs[0] < logs[1] < logs[2]
    assert logs[2] > sum(r.base_score for r in rows)


def test_odd_texts_and_nothing_to_learn(odd, no_docs):
    model = hm.fit(odd, states=2, classes=32, iterations=1, window=16)
    found = hm.score(odd, model)
    assert found.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = found.collect()
    assert len(rows) == odd.count() and all(math.isfinite(r.score) and r.n_known == r.n_tokens for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].n_tokens == by_id[3].n_tokens == by_id[4].n_tokens == 1
    assert by_id[5].score == pytest.approx(by_id[6].score) and by_id[5].n_tokens == 30_001
    nothing = hm.fit(no_docs, states=2, classes=32)
    assert hm.score(no_docs, nothing).collect() == []
    rows = hm.score(odd, nothing).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and math.isfinite(r.score) for r in rows)
