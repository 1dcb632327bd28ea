"""Chunking, indexing and search against literal loops."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annalake.functions import chunking, markup
from annalake.functions.vectors import cosine_similarity
from annalake.operators import corpus, similarity

WS = "\t\n\x0b\x0c\r  ﻿"


def fold(text, size, overlap):
    """Greedy packing, word for word as described, over UTF-16 lengths."""
    length = lambda s: len(s.encode("utf-16-le")) // 2
    chunks, current = [], ""
    for paragraph in re.split(r"\n\n+", text):
        if length(current) + length(paragraph) > size and length(current) > 0:
            chunks.append(current.strip(WS))
            words = re.split(f"[{WS}]+", current)
            kept = words[-(overlap // 5) :] if overlap >= 5 else []
            current = " ".join(kept) + "\n\n" + paragraph
        else:
            current += ("\n\n" if current else "") + paragraph
    if current.strip(WS):
        chunks.append(current.strip(WS))
    return chunks


def random_text(rng):
    words = ["alpha", "b", "Ünal", "\U0001f600", "long" * 30, "#", "## Title", "x y", ""]
    paragraphs = [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 25))]
    return rng.choice(["\n\n", "\n\n\n"]).join(paragraphs)


@pytest.mark.parametrize("size,overlap", [(500, 50), (60, 20), (20, 4), (1, 5)])
def test_packing_equals_the_fold(size, overlap):
    rng = random.Random(size)
    for _ in range(60):
        text = random_text(rng)
        assert list(chunking.pack_paragraphs(text, size, overlap)) == fold(text, size, overlap)


def test_long_paragraph_is_not_split_and_blank_text_has_no_chunk():
    assert list(chunking.pack_paragraphs("x" * 2000)) == ["x" * 2000]
    assert list(chunking.pack_paragraphs(" \n\n \n\n")) == []


def test_headers_and_sections():
    text = "# One\n\nfirst body\n\n## Two  \nsecond body\n####### seven\n#no\n\nthird"
    assert chunking.headers_in(text) == ["One", "Two  "]
    sections = chunking.Sections(text)
    assert sections.before("first body") == "One"
    assert sections.before("third") == "Two  "
    assert sections.before("# One") is None
    assert sections.before("not there") is None
    # A chunk found inside a header line: the part before it still counts.
    assert sections.before("wo  ") == "T"


def last_header_before(text, chunk):
    position = text.find(chunk)
    if position <= 0:
        return None
    found = re.findall(r"(?:\A|(?<=[\n\r  ]))#{1,6}[\s]+[^\n\r  ]+", text[:position])
    return re.sub(r"^#+\s+", "", found[-1]) if found else None


def test_sections_equal_a_scan_of_the_text_before():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["#", "# ", "## h", "\n", "a", " ", "b#"]) for _ in range(40))
        sections = chunking.Sections(text)
        for _ in range(10):
            start = rng.randrange(len(text))
            chunk = text[start : start + rng.randrange(1, 6)]
            assert sections.before(chunk) == last_header_before(text, chunk), (text, chunk)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    rows = [(i, random_text(rng)) for i in range(40)] + [(40, None), (41, "")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_chunk_documents(spark, docs):
    found = corpus.chunk_documents(docs, "doc_id", "text", size=60, overlap=20)
    by_doc = {}
    for r in found.orderBy("doc_id", "chunk_index").collect():
        by_doc.setdefault(r.doc_id, []).append(r.content)
    expected = {r.doc_id: fold(r.text, 60, 20) for r in docs.where("text is not null").collect()}
    assert by_doc == {k: v for k, v in expected.items() if v}


def test_one_document_with_very_many_chunks(spark):
    text = "\n\n".join(f"paragraph {i} " + "w" * 50 for i in range(9000))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    found = corpus.chunk_documents(docs, "doc_id", "text", size=40)
    assert found.count() == len(fold(text, 40, 50)) == 9000
    assert found.agg(F.max("chunk_index")).first()[0] == 8999


def test_chunking_does_not_shuffle(spark, docs):
    plan = corpus.index_documents(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_incremental_reindex(spark, docs):
    old = docs.where("doc_id < 30").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n\nold tail"))).otherwise(F.col("text")))
    gone = spark.createDataFrame([(99, "document no longer listed")], "doc_id bigint, text string")
    index = corpus.index_documents(old.unionByName(gone), "doc_id", "text")
    actions = {r.doc_id: r.action for r in corpus.reindex_plan(docs, index, "doc_id", "text").collect()}
    assert actions[35] == "new" and actions[3] == "changed" and actions[4] == "unchanged"
    result = corpus.incremental_reindex(docs, index, "doc_id", "text")
    expected = corpus.index_documents(docs.unionByName(gone), "doc_id", "text")
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "chunk_index", "content", F.coalesce("content_hash", F.lit(""))).collect()))
    assert rows(result) == rows(expected)
    hashes = result.where("content_hash is not null").select("chunk_index").distinct().collect()
    assert [r.chunk_index for r in hashes] == [0]


def test_statistics_and_duplicates(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id bigint, text string")
    found = corpus.duplicate_content(rows, "doc_id", "text").collect()
    assert [(r.n_copies, r.first_id) for r in found] == [(2, 1)]
    index = spark.createDataFrame([(1,), (1,), (2,)], "doc_id bigint")
    stats = corpus.index_stats(index, "doc_id").first()
    assert (stats.documents_count, stats.chunks_count, stats.avg_chunks_per_doc) == (2, 3, 1.5)
    empty = corpus.index_stats(index.where("doc_id > 9"), "doc_id").first()
    assert tuple(empty) == (0, 0, 0.0)


def test_context_layout(spark):
    rows = spark.createDataFrame(
        [("q", 2, "docs/b.md", None, 0.5, "B"), ("q", 1, "a.md", "Intro", 0.876, "A")],
        "query_id string, rank int, source_file string, section string, similarity double, content string",
    )
    assert corpus.assemble_context(rows, "query_id").first().context == (
        "### From a.md (Intro) [88% relevant]\n\nA\n\n---\n\n### From b.md [50% relevant]\n\nB"
    )


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(400, 8)).round(2)
    data[10] = 0
    data[20] = data[21] * 2  # same direction: a tie
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(500, [1.0, 2.0]), (501, None)]
    return data, spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)


def brute_force(queries, data, k, threshold):
    found = []
    data = data.astype(np.float32).astype(float)
    for q, vector in queries:
        scores = []
        for i, row in enumerate(data):
            norm = np.sqrt((vector**2).sum()) * np.sqrt((row**2).sum())
            scores.append((round(float(vector @ row / norm) if norm else 0.0, 9), i))
        kept = sorted([s for s in scores if threshold is None or s[0] >= threshold], key=lambda s: (-s[0], s[1]))[:k]
        found += [(q, i, s, rank) for rank, (s, i) in enumerate(kept, 1)]
    return found


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("k,threshold", [(5, 0.5), (7, None), (3, 0.99)])
def test_search_equals_brute_force(spark, vectors, monkeypatch, k, threshold, broadcast):
    data, index = vectors
    queries = [(f"q{i}", data[i % len(data)]) for i in range(30)]
    # Many small tiles must give the same answer as one.
    monkeypatch.setattr(similarity, "TILE_QUERIES", 8)
    monkeypatch.setattr(similarity, "TILE_ITEMS", 16)
    if not broadcast:
        monkeypatch.setattr(similarity, "BROADCAST_VALUES", 0)
    frame = spark.createDataFrame([(q, v.tolist()) for q, v in queries], "query_id string, embedding array<double>")
    found = similarity.similarity_search(frame, index, k=k, threshold=threshold)
    rows = sorted((r.query_id, r["rank"], r.vec_id, r.similarity) for r in found.collect())
    expected = sorted((q, rank, i, s) for q, i, s, rank in brute_force(queries, data, k, threshold))
    assert [r[:3] for r in rows] == [e[:3] for e in expected]
    assert np.allclose([r[3] for r in rows], [e[3] for e in expected], atol=1e-8)


def test_few_queries_scan_the_index_without_a_shuffle_of_it(spark, vectors):
    _, index = vectors
    frame = spark.createDataFrame([(f"q{i}", [1.0, float(i)] * 4) for i in range(3)], "query_id string, embedding array<double>")
    found = similarity.similarity_search(frame, index.coalesce(3), k=2, threshold=None)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning(query") > 0
    batches = index.select(F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("vector")).where("vector IS NOT NULL").toArrow().to_batches(max_chunksize=7)
    queries = frame.select(F.col("query_id").alias("query"), F.lit(None).cast("bigint").alias("item"), F.col("embedding").alias("vector")).toArrow()
    # What a task holds is cut back as it goes; it hands on k rows a query.
    parts = list(similarity._scan(iter(batches), queries, 2, None))
    assert sum(p.num_rows for p in parts) == 6
    one = sorted(zip(*[pa.Table.from_batches(parts)[c].to_pylist() for c in ("query", "item")]))
    assert one == sorted((r.query_id, r.vec_id) for r in found.collect())


def test_search_edge_cases(spark, vectors):
    _, index = vectors
    short = spark.createDataFrame([("s", [1.0, 2.0])], "query_id string, embedding array<double>")
    best = similarity.similarity_search(short, index, k=2, threshold=None).orderBy("rank").collect()
    assert [(r.vec_id, r.similarity) for r in best] == [(500, 1.0), (0, 0.0)]
    assert similarity.similarity_search(short.where("false"), index).count() == 0
    named = index.select(F.concat(F.lit("v"), "vec_id").alias("vec_id"), "embedding")
    assert similarity.similarity_search(short, named, k=1).first().vec_id == "v500"


def test_cosine_column(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<float>, b array<float>"
    )
    found = [r[0] for r in df.select(cosine_similarity(F.col("a"), F.col("b"))).collect()]
    assert found == pytest.approx([0.5**0.5, 0.0, 0.0])


def test_pages_become_text_with_headers(spark):
    page = (
        "<html><title>A\nb</title><style>p{}</style><script>var t='<h1>no</h1>';</script><nav><ul><li>x</li></ul></nav>"
        "<!-- <h2>no</h2> --><h1 class='t'>Top <b>of</b> it</h1><p>one<br/>two</p><H2>Sub</H2><p>three</p></html>"
    )
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "id bigint, html string")
    texts = dict(df.select("id", markup.markdown_of(F.col("html")).alias("text")).collect())
    assert texts == {1: "# A\n\nb\n\nx\n\n# Top of it\n\none\n\ntwo\n\n## Sub\n\nthree", 2: None, 3: ""}
    rows = corpus.chunk_documents(df.select("id", markup.markdown_of(F.col("html")).alias("text")), "id", "text", size=12, overlap=0, with_metadata=True)
    found = [(r.content, r.headers, r.section) for r in rows.orderBy("chunk_index").collect()]
    assert ("three", [], "Sub") in found and any(h == ["Top of it"] for _, h, _ in found)


def test_stored_index_rewrites_changed_parts_only(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = spark.createDataFrame([(i, f"text {i}\n\n" + "more words here " * (i % 5)) for i in range(60)], "doc_id bigint, text string").coalesce(2)
    first = corpus.index_documents(docs, "doc_id", "text", size=30).withColumn("vector", F.array(F.lit(1.0)))
    corpus.write_index(first, path, "doc_id", parts=16)

    def files():
        return {p: p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet")}

    before = files()
    corpus.refresh_index(docs, path, "doc_id", "text", parts=16, size=30)
    assert files() == before
    changed = docs.where("doc_id < 58").withColumn("text", F.when(F.col("doc_id") == 3, "other").otherwise(F.col("text"))).union(spark.createDataFrame([(100, "new")], docs.schema))
    expected = corpus.incremental_reindex(changed, first, "doc_id", "text", size=30)
    corpus.refresh_index(changed, path, "doc_id", "text", parts=16, size=30)
    columns = ["doc_id", "chunk_index", "content", "content_hash", "vector"]
    found = sorted(map(repr, corpus.read_index(spark, path).select(*columns).collect()))
    assert found == sorted(map(repr, expected.select(*columns).collect()))
    kept = {p.parent.name for p, at in files().items() if before.get(p) == at}
    parts = {p.parent.name for p in before}
    assert len(parts) >= 12 and len(parts - kept) <= 2
