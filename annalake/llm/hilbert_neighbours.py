"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected onto a few directions, put on a shifted grid and ordered
along a Hilbert curve; each of ``CURVES`` orderings has directions and a shift of
its own. Spark range-partitions the keys, which gives every vector its rank, and
ranks are cut into chunks. A query is held against the chunks around its own, on
every curve; what it finds is merged and ranked by the exact cosine.

A window is a share of the index, so recall doesn't fall as the index grows. For
vectors without any structure, which need the widest windows, the default finds
over nine tenths of the true neighbours (tests measure it against brute force);
vectors with structure need a smaller ``share``.

Equal vectors are one entry with its smallest ids, so a vector that very many
rows have is one candidate. Work goes out in tiles of one chunk and a bounded
number of queries. The grid is fitted to a bounded sample, all vectors are indexed.

Defined results: vectors that are NULL, empty, zero or hold a NULL or a value
that isn't finite take no part. Vectors of different lengths never meet. Rows
with a NULL id take no part. Rows that repeat an id and its vector count once.
A query with fewer candidates than ``k`` gets all that were found. Equal
nearness goes to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalake.llm.common import arrow_batch, scratch, stored

CURVES, DIRECTIONS, BITS = 12, 6, 8
#: Share of an ordering around a query that is searched.
SHARE = 0.15
#: Rows of a chunk, and chunks whose queries travel together.
CHUNK, TOGETHER = 2048, 32
#: Vectors that the grid is fitted to: those with the smallest hashed ids.
SAMPLE = 20_000
MAX_LENGTHS = 16
_U = np.uint64


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of grid cells (Skilling's transform)."""
    x = cells.astype(_U).T.copy()
    dims, one, top = len(x), _U(1), _U(1 << (bits - 1))
    q = top
    while q > one:
        below = q - one
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, _U(0), (x[0] ^ x[i]) & below)
            x[0] ^= np.where(high, below, swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), top
    while q > one:
        flip ^= np.where((x[-1] & q) > 0, q - one, _U(0))
        q >>= one
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> _U(bit)) & one)
    return key.astype(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten(), np.float64).reshape(len(column), -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares of huge or tiny values stay finite
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


class Grid:
    """Directions, scale and shift of every curve."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, seed: int = 7) -> None:
        dims = sample.shape[1]
        rng = np.random.default_rng(seed)
        wide = max(dims, DIRECTIONS)
        self.directions = [np.linalg.qr(rng.normal(size=(wide, wide)))[0][:dims, :DIRECTIONS] for _ in range(curves)]
        self.shift = rng.uniform(0, 1, size=(curves, DIRECTIONS))
        placed = [unit(sample) @ d for d in self.directions]
        self.middle = [p.mean(axis=0) for p in placed]
        self.spread = [p.std(axis=0) + 1e-12 for p in placed]

    def keys(self, vectors: np.ndarray) -> Iterator[np.ndarray]:
        units, side = unit(vectors), 1 << BITS
        for directions, middle, spread, shift in zip(self.directions, self.middle, self.spread, self.shift, strict=True):
            place = ((units @ directions - middle) / spread + 3) / 6 * (side - 1) + shift
            yield hilbert_keys(np.clip(np.floor(place), 0, side - 1).astype(np.int64), BITS)


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def _ranked(entries: DataFrame, grid: Grid, folder: str) -> DataFrame:
    """(entry, curve, rank): every entry's place in every ordering."""
    shared = entries.sparkSession.sparkContext.broadcast(grid)

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                for curve, key in enumerate(shared.value.keys(_matrix(batch.column("vector")))):
                    yield arrow_batch({"curve": np.full(len(key), curve), "key": key, "entry": batch.column("entry")}, {"curve": pa.int32(), "key": pa.int64(), "entry": pa.int64()})

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, so_far = TaskContext.get().partitionId(), {}
        types = {"entry": pa.int64(), "curve": pa.int32(), "part": pa.int32(), "at": pa.int64()}
        for batch in batches:
            curve = np.array(batch.column("curve"))
            for one in np.unique(curve).tolist():
                entry = np.array(batch.column("entry"))[curve == one]
                at = so_far.get(one, 0) + np.arange(len(entry))
                so_far[one] = so_far.get(one, 0) + len(entry)
                yield arrow_batch({"entry": entry, "curve": np.full(len(entry), one), "part": np.full(len(entry), part), "at": at}, types)

    keyed = entries.select("entry", "vector").mapInArrow(keys, "curve int, key long, entry long")
    ordered = keyed.repartitionByRange("curve", "key", "entry").sortWithinPartitions("curve", "key", "entry").select("curve", "entry")
    placed = stored(ordered.mapInArrow(number, "entry long, curve int, part int, at long"), f"{folder}/placed")
    counts = placed.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("curve", "part", (F.sum("n").over(W.partitionBy("curve").orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    return placed.join(before, ["curve", "part"]).select("entry", "curve", (F.col("before") + F.col("at")).alias("rank"))


def _tile(table: pa.Table, k: int) -> pa.Table:
    """The best ``k`` and ties of a tile's chunk for each of its queries."""
    is_query = np.array(table.column("is_query"))
    rows = table.combine_chunks()
    queries, own = rows.filter(pa.array(is_query)), rows.filter(pa.array(~is_query))
    types = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
    if not len(queries) or not len(own):
        return pa.table({n: pa.array([], t) for n, t in types.items()})
    chunk = unit(_matrix(own.column("vector").combine_chunks()))
    ids = own.column("ids").to_pylist()
    out: dict[str, list] = {n: [] for n in types}
    for start in range(0, len(queries), 256):
        part = queries.slice(start, 256)
        wanted = unit(_matrix(part.column("vector").combine_chunks()))
        near = wanted @ chunk.T
        keep = min(k + 1, near.shape[1])
        least = -np.partition(-near, keep - 1, axis=1)[:, keep - 1]
        for query, (row, floor) in enumerate(zip(near, least, strict=True)):
            query_id = part.column("ids")[query].as_py()[0]
            places = np.flatnonzero(row >= floor - 1e-12)
            scores = (chunk[places] * wanted[query]).sum(axis=1)
            found = sorted((-s, i) for s, p in zip(scores.tolist(), places.tolist(), strict=True) for i in ids[p] if i != query_id)[:k]
            out["query_id"] += [query_id] * len(found)
            out["vec_id"] += [i for _, i in found]
            out["score"] += [-s for s, _ in found]
    return pa.table({n: pa.array(out[n], t) for n, t in types.items()})


def _search(rows: DataFrame, k: int, share: float, every: int, folder: str) -> DataFrame:
    """rows: (vec_id, vector), vectors of one length."""
    # An entry keeps one id more than is asked for, as a query leaves out its own.
    same = W.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("n", F.dense_rank().over(same)).where(F.col("n") <= k + 1)
    entries = few.groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).withColumn("entry", F.col("ids")[0])
    entries = stored(entries.select("entry", "ids", "vector"), f"{folder}/entries")
    sample = entries.orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE).select("vector").toArrow()
    ranked = _ranked(entries, Grid(_matrix(sample.column("vector").combine_chunks())), folder)
    n = entries.count()
    chunks = (n + CHUNK - 1) // CHUNK
    reach = int(np.ceil(share * chunks / 2))

    chunk = F.floor(F.col("rank") / CHUNK).cast("int")
    places = stored(ranked.groupBy("entry").agg(F.collect_list(F.struct("curve", chunk.alias("chunk"))).alias("places")), f"{folder}/places")  # one for each curve
    placed = entries.join(places, "entry")
    own = placed.select("ids", "vector", F.explode("places").alias("p")).select("p.curve", "p.chunk", "ids", "vector", F.lit(False).alias("is_query"))
    around = F.sequence(F.floor(F.greatest(F.col("chunk") - reach, F.lit(0)) / TOGETHER), F.floor((F.col("chunk") + reach) / TOGETHER))
    own = own.withColumn("together", F.explode(around))
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).distinct()
    asked = asked.join(entries.select("vector", "entry"), "vector").join(places, "entry")
    asked = asked.select(F.array("vec_id").alias("ids"), "vector", F.explode("places").alias("p"))
    asked = asked.select("p.curve", F.col("p.chunk").alias("home"), "ids", "vector", F.lit(True).alias("is_query"))
    window = F.sequence(F.greatest(F.col("home") - reach, F.lit(0)), F.least(F.col("home") + reach, F.lit(chunks - 1)))
    asked = asked.withColumn("chunk", F.explode(window)).withColumn("together", F.floor(F.col("home") / TOGETHER))
    columns = ["curve", "chunk", "together", "ids", "vector", "is_query"]
    tiles = own.select(columns).unionByName(asked.select(columns)).groupBy("curve", "chunk", "together")
    found = tiles.applyInArrow(lambda table: _tile(table, k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, every: int, k: int = 5, share: float = SHARE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine) for the rows whose id is divisible by ``every``."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector")).where(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    lengths = [r["n"] for r in rows.groupBy(F.size("vector").alias("n")).count().orderBy("n").limit(MAX_LENGTHS + 1).collect()]
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} lengths")
    folder, found = scratch(vectors.sparkSession), None
    for n in lengths:
        part = _search(rows.where(F.size("vector") == n), k, share, every, f"{folder}/{n}")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return found
