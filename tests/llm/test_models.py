"""Classifiers by held-out accuracy, and what they say about odd texts."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests_llm_common import sentence

from annalake.llm import language_id, quality, toxicity
from annalake.llm.common import held_out
from annalake.llm.queries import QUERIES

FOREIGN = "fluss stein wolke papier grün straße über äpfel höhe brücke schön größe".split()
BAD = "idiot scum worthless pathetic".split()


def corpus(n=400, seed=1):
    """(doc_id, text, lang, toxic, quality): two languages, some insults, some junk."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        words = (sentence(rng, 40) if lang == "en" else " ".join(rng.choices(FOREIGN, k=40))).split()
        toxic, sound = int(rng.random() < 0.3), int(rng.random() < 0.75)
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        if not sound:
            words = [w + rng.choice(["***", "###", "|"]) for w in words]
        rows.append((i, " ".join(words), lang, toxic, sound))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id bigint, text string, lang string, toxic int, quality int").cache()


def test_language_of_held_out_texts(docs):
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"))))
    assert model.languages == ("de", "en")
    rows = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_counts_equal_plain_python(spark, docs):
    model = language_id.fit(docs, buckets=1 << 12)
    features = {}
    for r in docs.collect():
        one, starts, ends = language_id._features([r.text], 1 << 12)
        for n, f in zip(language_id.ORDERS, one, strict=True):
            features.setdefault(r.lang, Counter()).update(f[starts[0] : ends[0] - n + 1].tolist())
    for lang, row in zip(model.languages, model.log_probability, strict=True):
        counts = np.array([features[lang][b] for b in range(1 << 12)]) + language_id.SMOOTHING
        assert np.allclose(row, np.log(counts / counts.sum()), atol=1e-4)


def test_language_of_odd_texts(docs, odd, no_docs):
    model = language_id.fit(docs)
    rows = language_id.identify(odd, model).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect())
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {2, 3, 4, 7, None}
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert language_id.identified(odd, model).columns == odd.columns
    nothing = language_id.fit(no_docs)
    assert {r.lang_pred for r in language_id.identify(docs.limit(3), nothing).collect()} == {"und"}
    assert language_id.identify(no_docs, model).count() == 0
    assert language_id.fit(odd).languages == ("de", "en")


def test_toxicity_of_held_out_texts(docs):
    model = toxicity.fit(docs.where(~held_out(F.col("doc_id"))), docs.select("doc_id", "toxic"))
    rows = toxicity.detect(docs, model).join(docs.select("doc_id", "toxic"), "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.95
    assert all(r.predicted == (r.score >= 0.7) for r in rows)
    kept = {r.doc_id for r in toxicity.clean(docs, model).collect()}
    assert kept == {r.doc_id for r in toxicity.detect(docs, model).collect() if not r.predicted}


def plain_kneser_ney(texts_by_label):
    """log P of each byte by the interpolated definition, with dictionaries."""
    top = {}
    for label, texts in texts_by_label.items():
        for t in texts:
            data = b" " + t.lower().encode()
            for i in range(len(data)):
                gram = (b"\0" * toxicity.ORDER + data)[i + 1 : i + 1 + toxicity.ORDER]
                top.setdefault(label, Counter())[gram] += 1
    levels = {(toxicity.ORDER, label): c for label, c in top.items()}
    for order in range(toxicity.ORDER, 1, -1):
        found = {}
        for (o, label), grams in list(levels.items()):
            if o == order:
                target = found.setdefault(-1 if order - 1 <= toxicity.SHARED else label, set())
                target.update(grams)
        for label, grams in found.items():
            levels[order - 1, label] = Counter(g[1:] for g in grams)

    def probability(gram, order, label):
        if order == 0:
            return 1 / 256
        grams = levels[order, -1 if order <= toxicity.SHARED else label]
        own = {g: n for g, n in grams.items() if g[:-1] == gram[:-1]}
        lower = probability(gram[1:], order - 1, label)
        if not own:
            return lower
        total = sum(own.values())
        return max(own.get(gram, 0) - toxicity.DISCOUNT, 0) / total + toxicity.DISCOUNT * len(own) / total * lower

    return probability


def test_ratios_equal_plain_kneser_ney(spark):
    texts = {0: ["the river runs", "a stone house by the river"], 1: ["the scum runs", "you scum"]}
    rows = [(i, t, label) for i, (label, t) in enumerate((label, t) for label, own in texts.items() for t in own)]
    learn = spark.createDataFrame([(0, label, t) for _, t, label in rows], "fold int, label int, text string")
    counted = learn.mapInArrow(toxicity._count, "fold int, label int, gram long, n long").groupBy("fold", "label", "gram").agg(F.sum("n").alias("n"))
    dense = toxicity._tables(counted, toxicity.scratch(spark))
    half, whole = (toxicity.Models.of(dense, model) for model in (0, 1))
    probability = plain_kneser_ney(texts)
    text = "the scum house"
    grams, _, _ = toxicity._grams(pa.array([text]))
    data = b"\0" * toxicity.ORDER + b" " + text.encode()
    wanted = []
    for i in range(len(text) + 1):
        gram = data[i + 1 : i + 1 + toxicity.ORDER]
        wanted.append(np.log(probability(gram, toxicity.ORDER, 1)) - np.log(probability(gram, toxicity.ORDER, 0)))
    assert np.allclose(whole.ratios(grams), wanted, atol=1e-3)
    assert np.allclose(half.ratios(grams), wanted, atol=1e-3)


def test_every_gram_has_its_own_entry(spark):
    """More n-grams than a table of 2^20 has room for: each keeps its own count, and
    those that weren't seen score as plain Kneser-Ney without them."""
    n = 600_000
    grams = np.random.default_rng(4).choice(1 << 40, 2 * n, replace=False).astype(np.int64)
    rows = spark.createDataFrame(pa.table({"fold": np.zeros(n, np.int32), "label": (np.arange(n) % 2).astype(np.int32), "gram": grams[:n], "n": np.arange(1, n + 1)}))
    top = toxicity.Models.of(toxicity._tables(rows, toxicity.scratch(spark)), 1).levels[-1]
    assert len(top.grams) == n
    slots = toxicity._slots(top.grams, grams.view(np.uint64))
    assert (slots[n:] == len(top.grams)).all() and not top.counts[:, -1].any()
    at = np.arange(n)
    assert (top.counts[at % 2, slots[:n]] == at + 1).all() and not top.counts[1 - at % 2, slots[:n]].any()


def test_toxicity_of_odd_texts(docs, odd, no_docs):
    labels = docs.select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.union(labels).unionByName(labels.limit(2).withColumn("toxic", F.lit(None).cast("int"))))
    rows = toxicity.detect(odd, model).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect())
    assert all(0 <= r.score <= 1 for r in rows)
    assert toxicity.clean(odd, model).columns == odd.columns
    assert toxicity.detect(no_docs, model).count() == 0
    nothing = toxicity.fit(no_docs, labels)
    assert {r.score for r in toxicity.detect(odd, nothing).collect()} == {0.0}
    assert {r.score for r in toxicity.detect(odd, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}
    assert toxicity.clean(odd, nothing).count() == odd.count()


def grade():
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)


def test_grades_of_held_out_texts(docs):
    model = quality.fit(docs.where(~held_out(F.col("doc_id"))), docs.select("doc_id", "toxic", "quality"), grade())
    assert (np.diff(model.thresholds) > 0).all()
    rows = quality.rate(docs, model, reach=1).join(docs.select("doc_id", "quality", grade().alias("grade")), "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert np.mean([r.selected == (r.quality == 1) for r in rows]) > 0.95
    by_grade = [np.mean([r.expected_grade for r in rows if r.grade == g]) for g in (0, 1, 2)]
    assert by_grade == sorted(by_grade) and by_grade[2] - by_grade[0] > 1
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail <= 1 for r in rows)


def test_gradient_climbs_to_the_maximum():
    """Moving away from the fitted parameters doesn't raise the penalised likelihood."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3)).astype(np.float32)
    y = np.digitize(x @ np.array([1.5, -1, 0]) + rng.logistic(size=500), [-1, 1])
    model = quality.fit_ordinal(x, y, np.array([0, 1, 2]))

    def value(w, theta):
        edges = np.concatenate([[-50], theta, [50]])
        cdf = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
        s = x @ w
        return np.log(np.maximum(cdf(edges[y + 1] - s) - cdf(edges[y] - s), 1e-12)).mean() - quality.RIDGE / 2 * w @ w

    best = value(model.weights, model.thresholds)
    for _ in range(200):
        assert value(model.weights + rng.normal(size=3) * 0.05, model.thresholds + rng.normal(size=2) * 0.05) <= best + 1e-3
    assert np.sign(model.weights[:2]).tolist() == [1, -1]


def test_grades_of_odd_texts(docs, odd, no_docs):
    ratings = docs.select("doc_id", "toxic", "quality")
    model = quality.fit(docs, ratings.union(ratings), grade())
    rows = quality.rate(odd, model, reach=2).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect())
    assert all(0 <= r.expected_grade <= 2 for r in rows)
    none = quality.fit(no_docs, ratings, grade())
    assert {(r.expected_grade, r.tail) for r in quality.rate(odd, none, reach=1).collect()} == {(0.0, 0.0)}
    one = quality.fit(docs, ratings.where("quality = 1 AND toxic = 0"), grade())
    assert {(r.expected_grade, r.tail) for r in quality.rate(odd, one, reach=1).collect()} == {(2.0, 1.0)}
    assert quality.rate(no_docs, model, reach=1).count() == 0


@pytest.mark.parametrize("name", ["op5_language_id", "op6_quality", "op7_toxicity"])
def test_queries_split_by_hash(spark, name):
    import zlib

    rows = QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
