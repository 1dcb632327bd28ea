"""The pipeline against its stages by brute force, on documents with planted cases."""

import random

import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from test_models import corpus
from test_pairs import components_by_force, leaks_by_force
from tests_llm_common import sentence

import corpus_pipeline
from annalake.llm import language_id, toxicity
from annalake.llm.common import held_out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rng = random.Random(7)
    rows = [(i, t, lang, "src", len(t)) for i, t, lang, _, _ in corpus(300, seed=7)]
    items = [(i, sentence(rng, 25)) for i in range(4)]
    rows += [(1000 + i, rows[i][1] + " extra", rows[i][2], "copy", 0) for i in range(0, 60, 3)]
    rows += [(2000 + i, f"{sentence(rng, 20)} {items[i][1]} {sentence(rng, 20)}", "en", "leak", 0) for i in range(4)]
    rows += [(3000, None, "en", "odd", 0), (3001, "", None, "odd", 0), (3002, "12 ...", "en", "odd", 0), (None, sentence(rng, 30), "en", "odd", 0)]
    labels = [(i, sound, toxic) for i, _, _, toxic, sound in corpus(300, seed=7)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    frame, frames = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        frames[name] = frame
        out = f"{folder}/stage-{name}"
        stage(spark, frame, folder).write.parquet(out)
        frame = spark.read.parquet(out)
        kept[name] = frame.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert frame.columns == columns

    def given(name):
        return [(r.doc_id, r.text) for r in frames[name].collect()]

    def ids(name):
        return sorted((r.doc_id is None, r.doc_id or 0) for r in kept[name])

    def as_ids(rows):
        return sorted((i is None, i or 0) for i in rows)

    model = toxicity.fit(docs.where(~held_out(F.col("doc_id"))), spark.read.parquet(f"{folder}/labels.parquet"))
    assert ids("toxicity") == as_ids(r.doc_id for r in toxicity.detect(docs, model).collect() if not r.predicted)
    assert 30 < docs.count() - len(kept["toxicity"]) < 130
    frame = frames["language_id"]
    found = language_id.identify(frame, language_id.fit(frame.where(~held_out(F.col("doc_id"))))).collect()
    assert ids("language_id") == as_ids(r.doc_id for r in found if r.lang_pred != "und" and r.score >= 0.5)
    assert {r.doc_id for r in found if r.lang_pred == "und"} == {3000, 3001, 3002}
    groups = components_by_force([(i, t) for i, t in given("jaccard_join") if i is not None])
    assert ids("jaccard_join") == as_ids([*(i for i, (_, c) in groups.items() if i == c), None])
    assert not {r.doc_id for r in kept["jaccard_join"]} & {c for c in range(1000, 1100) if c - 1000 in {i for i, _ in given("jaccard_join")}}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaked = {i for i, _ in leaks_by_force(given("decontamination"), items)}
    assert leaked == {2000, 2001, 2002, 2003}
    assert ids("decontamination") == as_ids(i for i, _ in given("decontamination") if i not in leaked)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {i: t for i, t in given("sentence_pieces")}
    assert {r.doc_id: r.ids for r in kept["sentence_pieces"]} == {i: library.encode(t) for i, t in texts.items()}
    assert all(r.same for r in kept["sentence_pieces"])


def test_run_applies_all_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert rows.columns == ["doc_id", "ids", "n_ids", "ids_crc32", "n_bytes", "same"]
    assert rows.count() > 100 and rows.where("NOT same").count() == 0
