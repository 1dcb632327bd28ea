"""Document index: chunks, change detection, statistics and prompt context."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalake.functions import chunking
from annalake.functions.chunking import (
    CHUNK_OVERLAP,
    CHUNK_SIZE,
    PARAGRAPH_SEPARATOR,
    Sections,
    headers_in,
    pack_paragraphs,
)
from annalake.operators.matching import absent_from, present_in
from annalake.sources.sinks import write_once

# The helpers travel with the task, so workers need no installed package.
cloudpickle.register_pickle_by_value(chunking)

# A stored index is cut into so many parts; the column that tells them apart.
INDEX_PARTS = 64
PART = "index_part"

# How retrieved chunks are laid out in a context.
CONTEXT_SEPARATOR = "\n\n---\n\n"


def chunk_documents(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separator: str = PARAGRAPH_SEPARATOR,
    with_metadata: bool = False,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(id, chunk_index, content[, headers, section][, carried...]) of every document.

    Packing is a fold along one text with a growing string, which the built-in
    ``aggregate`` would copy at each step; it runs as an Arrow map over the
    scan instead, with no shuffle. The metadata needs the full text beside the
    chunk and is therefore taken in the same pass; ``carry`` names document
    columns to repeat on the chunks, which saves joining them back. Chunks
    leave in bounded batches, however many one document has.
    """
    out = [
        T.StructField(id_col, docs.schema[id_col].dataType),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("content", T.StringType()),
    ]
    if with_metadata:
        out += [
            T.StructField("headers", T.ArrayType(T.StringType())),
            T.StructField("section", T.StringType()),
        ]
    out += [docs.schema[name] for name in carry]
    names = [f.name for f in out]
    rows_per_batch = 4096

    def chunks_of(text: str) -> Iterator[tuple]:
        sections = Sections(text) if with_metadata else None
        for index, chunk in enumerate(pack_paragraphs(text, size, overlap, separator)):
            if sections is None:
                yield index, chunk
            else:
                yield index, chunk, headers_in(chunk), sections.before(chunk)

    types = [pa.int32(), pa.string(), *([pa.list_(pa.string()), pa.string()] if with_metadata else [])]

    def as_batch(source: pa.RecordBatch, owners: list[int], rows: list[tuple]) -> pa.RecordBatch:
        owner = pa.array(owners, pa.int64())
        made = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), types, strict=True)]
        repeated = [source.column(2 + i).take(owner) for i in range(len(carry))]
        return pa.RecordBatch.from_arrays([source.column(0).take(owner), *made, *repeated], names=names)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners: list[int] = []
            rows: list[tuple] = []
            for position, text in enumerate(batch.column(1)):
                if not text.is_valid:
                    continue
                for row in chunks_of(text.as_py()):
                    owners.append(position)
                    rows.append(row)
                    if len(rows) == rows_per_batch:
                        yield as_batch(batch, owners, rows)
                        owners, rows = [], []
            if rows:
                yield as_batch(batch, owners, rows)

    return docs.select(id_col, text_col, *carry).mapInArrow(split, T.StructType(out))


def content_hash(text: Column) -> Column:
    return F.md5(text)


def index_documents(docs: DataFrame, id_col: str, text_col: str, **chunking_options) -> DataFrame:
    """Chunk rows as the index stores them: the document's hash on chunk 0 only."""
    hashed = docs.select(id_col, text_col, content_hash(F.col(text_col)).alias("content_hash"))
    chunks = chunk_documents(hashed, id_col, text_col, carry=["content_hash"], **chunking_options)
    return chunks.withColumn("content_hash", F.when(F.col("chunk_index") == 0, F.col("content_hash")))


def reindex_plan(docs: DataFrame, index: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, content_hash, action): new, changed or unchanged against the index."""
    known = index.where("chunk_index = 0").select(id_col, F.col("content_hash").alias("_known"), F.lit(True).alias("_indexed"))
    action = (
        F.when(F.col("_indexed").isNull(), "new")
        .when(F.col("_known") == F.col("content_hash"), "unchanged")
        .otherwise("changed")
    )
    return (
        docs.select(id_col, content_hash(F.col(text_col)).alias("content_hash"))
        .join(known, id_col, "left")
        .select(id_col, "content_hash", action.alias("action"))
    )


def incremental_reindex(docs: DataFrame, index: DataFrame, id_col: str, text_col: str, **chunking_options) -> DataFrame:
    """The index after a run: unchanged documents keep their chunks, changed
    ones get theirs replaced, new ones are added. Chunks of documents that are
    not in ``docs`` stay. Only new and changed texts are chunked; columns that
    the index has besides (a vector, metadata) are NULL in their chunks."""
    plan = reindex_plan(docs, index, id_col, text_col)
    stale = plan.where("action = 'changed'").select(id_col)
    todo = docs.join(plan.where("action <> 'unchanged'").select(id_col), id_col, "left_semi")
    # One document may own a large part of the chunks.
    kept = absent_from(index, stale, [id_col])
    made = index_documents(todo, id_col, text_col, **chunking_options)
    # What an index holds besides, vectors say, new chunks don't have yet.
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in index.schema.fields if f.name not in made.columns]
    return kept.unionByName(made.select("*", *rest).select(*[f"`{c}`" for c in index.columns]))


def _part(id_col: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int")


def write_index(index: DataFrame, path: str, id_col: str, parts: int = INDEX_PARTS) -> None:
    """Store an index in parts by a hash of the document."""
    placed = index.withColumn(PART, _part(id_col, parts))
    placed.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(PART)


def refresh_index(docs: DataFrame, path: str, id_col: str, text_col: str, parts: int = INDEX_PARTS, **chunking_options) -> None:
    """``incremental_reindex`` on a stored index. The plan is made once, texts are
    hashed there; the parts that hold new or changed documents are read and
    replaced, all others are neither read nor written. ``parts`` is the number the
    index was stored with; about as many as documents change in a run keep what is
    rewritten in proportion. Repeated after a failure it finds less to do."""
    spark = docs.sparkSession
    index = spark.read.parquet(path)
    plan = write_once(reindex_plan(docs, index, id_col, text_col).where("action <> 'unchanged'").withColumn(PART, _part(id_col, parts)))
    touched = [r[0] for r in plan.select(PART).distinct().collect()]  # at most ``parts``
    if not touched:
        return
    todo = present_in(docs, plan, [id_col])
    made = index_documents(todo, id_col, text_col, **chunking_options)
    kept = absent_from(index.where(F.col(PART).isin(touched)).drop(PART), plan.where("action = 'changed'"), [id_col])
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in kept.schema.fields if f.name not in made.columns]
    write_index(kept.unionByName(made.select("*", *rest)), path, id_col, parts)


def chunk_stats(index: DataFrame, id_col: str) -> DataFrame:
    """Chunks per document."""
    return index.groupBy(id_col).agg(F.count(F.lit(1)).alias("chunks"))


def index_stats(index: DataFrame, id_col: str) -> DataFrame:
    """Documents, chunks and mean chunks per document, one row."""
    return chunk_stats(index, id_col).agg(
        F.count(F.lit(1)).alias("documents_count"),
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks_count"),
        F.coalesce(F.avg("chunks"), F.lit(0.0)).alias("avg_chunks_per_doc"),
    )


def duplicate_content(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Hashes shared by several rows: count and smallest id, no lists."""
    return (
        rows.select(id_col, content_hash(F.col(text_col)).alias("content_hash"))
        .groupBy("content_hash")
        .agg(F.count(F.lit(1)).alias("n_copies"), F.min(id_col).alias("first_id"))
        .where("n_copies > 1")
    )


def assemble_context(results: DataFrame, query_col: str, content_col: str = "content") -> DataFrame:
    """One context text per query from its ranked results.

    ``results`` has query, rank, source_file, section, similarity and content;
    a query owns at most k rows, so the list per group is bounded by k.
    """
    basename = F.element_at(F.split(F.col("source_file"), "/"), -1)
    section = F.when(F.col("section").isNotNull() & (F.col("section") != ""), F.concat(F.lit(" ("), F.col("section"), F.lit(")")))
    percent = F.round(F.col("similarity") * 100, 0).cast("int").cast("string")
    block = F.concat(
        F.lit("### From "), basename, F.coalesce(section, F.lit("")), F.lit(" ["), percent, F.lit("% relevant]\n\n"), F.col(content_col)
    )
    ranked = F.sort_array(F.collect_list(F.struct("rank", block.alias("block"))))
    return results.groupBy(query_col).agg(F.array_join(F.transform(ranked, lambda r: r["block"]), CONTEXT_SEPARATOR).alias("context"))
