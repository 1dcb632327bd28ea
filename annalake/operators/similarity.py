"""Exact cosine search over an index of vectors."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from annalake.sources.sinks import write_once

# The helpers travel with the task, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Search defaults.
TOP_K = 5
THRESHOLD = 0.5

# Similarities equal to this many decimals count as ties, broken by id.
TIE_DECIMALS = 9
# Numbers in the vectors of queries that are broadcast at most: 32 MB.
BROADCAST_VALUES = 4 << 20
# About so many queries and items meet in one tile.
TILE_QUERIES = 512
TILE_ITEMS = 8192


def _unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero."""
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(norms == 0, 1.0, norms)[:, None]


def _scores(queries: pa.ListArray, items: pa.ListArray) -> np.ndarray:
    """Cosine of every query with every item; 0 where the lengths differ."""
    scores = np.zeros((len(queries), len(items)))
    lengths = [pc.list_value_length(a).to_numpy(zero_copy_only=False) for a in (queries, items)]
    for length in np.intersect1d(*lengths):
        if length:
            rows = [np.flatnonzero(own == length) for own in lengths]
            left, right = (
                pc.fill_null(pc.list_flatten(a.take(pa.array(r))), 0.0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, int(length))
                for a, r in zip((queries, items), rows, strict=True)
            )
            scores[np.ix_(*rows)] = _unit(left) @ _unit(right).T
    return scores


def _best(table: pa.Table, k: int, threshold: float | None) -> pa.Table:
    """The ``k`` best items of a tile for each of its queries, ties by item."""
    table = table.combine_chunks()
    is_query = pc.is_null(table["item"])
    queries = table.filter(is_query)
    items = table.filter(pc.invert(is_query)).sort_by("item")
    vectors = [t["vector"].combine_chunks() for t in (queries, items)]
    if not len(queries) or not len(items):
        rows = columns = np.zeros(0, np.int64)
        scores = np.zeros(0)
    else:
        all_scores = _scores(*vectors)
        wanted = np.ones(all_scores.shape, bool) if threshold is None else all_scores >= threshold
        all_scores = np.round(all_scores, TIE_DECIMALS)
        place = max(all_scores.shape[1] - k, 0)
        kth = np.partition(np.where(wanted, all_scores, -np.inf), place, axis=1)[:, place]
        rows, columns = np.nonzero(wanted & (all_scores >= kth[:, None]))
        order = np.lexsort((columns, -all_scores[rows, columns], rows))
        rows, columns = rows[order], columns[order]
        first = np.searchsorted(rows, rows)
        few = np.arange(len(rows)) - first < k
        rows, columns = rows[few], columns[few]
        scores = all_scores[rows, columns]
    return pa.table({"query": queries["query"].take(pa.array(rows)), "item": items["item"].take(pa.array(columns)), "similarity": pa.array(scores, pa.float64())})


def _numbered(df: DataFrame, key: Column, tile: int) -> tuple[DataFrame, int]:
    """Rows dealt by a hash of their key to parts of about ``tile`` rows, and the number of parts."""
    parts = max(1, -(-df.count() // tile))
    return df.withColumn("_own", F.pmod(F.xxhash64(key), F.lit(parts))), parts


def _scan(batches: Iterable[pa.RecordBatch], queries: pa.Table, k: int, threshold: float | None) -> Iterator[pa.RecordBatch]:
    """The ``k`` best items of a task for each query."""
    best: list[pa.Table] = []
    held = 0

    def fewer() -> pa.Table:
        found = pa.concat_tables(best).sort_by([("query", "ascending"), ("similarity", "descending"), ("item", "ascending")])
        codes = found["query"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        first = _first_of_run(codes)
        return found.filter(pa.array(np.arange(len(codes)) - first < k))

    for batch in batches:
        items = pa.table({"query": pa.nulls(batch.num_rows, queries.schema.field("query").type), "item": batch.column("item"), "vector": batch.column("vector").cast(queries.schema.field("vector").type)})
        found = _best(pa.concat_tables([queries, items]), k, threshold)
        best.append(found)
        held += found.num_rows
        if held > 4 * k * queries.num_rows:
            best = [fewer()]
            held = best[0].num_rows
    if best:
        yield from fewer().to_batches()


def _first_of_run(codes: np.ndarray) -> np.ndarray:
    """Where each element's run of equal ones starts."""
    starts = np.flatnonzero(np.diff(codes, prepend=codes[:1] - 1) != 0)
    return starts[np.cumsum(np.isin(np.arange(len(codes)), starts)) - 1]


def similarity_search(
    queries: DataFrame,
    index: DataFrame,
    query_id: str = "query_id",
    query_vector: str = "embedding",
    item_id: str = "vec_id",
    item_vector: str = "embedding",
    k: int = TOP_K,
    threshold: float | None = THRESHOLD,
) -> DataFrame:
    """(query, item, similarity, rank): the ``k`` most similar items per query.

    Brute force and exact. Queries whose vectors have at most ``BROADCAST_VALUES``
    numbers are broadcast, and the index is scanned where it lies: a task hands on
    ``k`` rows for each query, nothing else is shuffled. More queries are dealt to
    parts by hash, as the items are, and every pair of parts is a tile of bounded
    size, scored with one matrix product on the executors; a tile returns at most
    ``k`` rows for each query.
    The threshold applies to the similarity itself; ties are those of its first
    decimals. Items without a vector are skipped; a zero vector or a vector of
    another length has similarity 0.
    """
    query_type, item_type = queries.schema[query_id].dataType, index.schema[item_id].dataType

    def rows(df: DataFrame, key: str, vector: str) -> DataFrame:
        return df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{vector}`").cast("array<double>").alias("vector")).where("vector IS NOT NULL")

    schema = T.StructType([T.StructField("query", query_type), T.StructField("item", item_type), T.StructField("similarity", T.DoubleType())])
    asked = write_once(rows(queries, query_id, query_vector))
    held = rows(index, item_id, item_vector).where("_key IS NOT NULL")
    size = asked.agg(F.coalesce(F.sum(F.size("vector") + 1), F.lit(0))).first()[0]
    if size <= BROADCAST_VALUES:
        few = asked.select(F.col("_key").alias("query"), F.lit(None).cast(item_type).alias("item"), "vector").toArrow()
        shared = queries.sparkSession.sparkContext.broadcast(few)
        found = held.select(F.col("_key").alias("item"), "vector").mapInArrow(lambda batches: _scan(batches, shared.value, k, threshold), schema)
    else:
        found = _tiles(asked, held, query_type, item_type, k, threshold, schema)
    order = Window.partitionBy("query").orderBy(F.col("similarity").desc(), F.col("item").asc())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(query_id), F.col("item").alias(item_id), "similarity", "rank")


def _tiles(asked: DataFrame, held: DataFrame, query_type: T.DataType, item_type: T.DataType, k: int, threshold: float | None, schema: T.StructType) -> DataFrame:
    """Both sides dealt to parts; every pair of parts is scored by itself."""
    asked, query_parts = _numbered(asked, F.col("_key"), TILE_QUERIES)
    held, item_parts = _numbered(held, F.col("_key"), TILE_ITEMS)
    asked = asked.select(F.col("_key").alias("query"), F.lit(None).cast(item_type).alias("item"), "vector", F.col("_own").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(item_parts - 1))).alias("i"))
    held = held.select(F.lit(None).cast(query_type).alias("query"), F.col("_key").alias("item"), "vector", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))).alias("q"), F.col("_own").alias("i"))
    tiles = asked.unionByName(held).groupBy("q", "i")
    return tiles.applyInArrow(lambda table: _best(table.select(["query", "item", "vector"]), k, threshold), schema)
