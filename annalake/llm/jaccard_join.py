"""Exact Jaccard join of documents on their word shingles.

Equal sets are one node. A node posts its prefix under a first global order of
the shingles; nodes that meet in a posting list within the size and positional
bounds are candidates. They must also share prefix shingles under further
orders, and only what passes all of them is verified exactly.

Every order puts shingles of frequent counters last (counts of all documents in
a fixed number of hashed counters, so the broadcast is bounded) and breaks ties
by a hash of its own. Any order that is the same everywhere loses no pair. Before
texts are fetched, the numbers of shingles in hashed buckets bound from above
what two sets can have in common.

A row of a posting list that the bounds pair with no other row is dropped before
the list is stored: the larger the corpus, the longer the lists of texts that share
a passage and little else.

Links inside one component needn't all be found to know the component. So each
posting list first links neighbours only, in two sequences, which is linear in
its length; then only candidates between different components are paired, and where
the bounds leave many pairs a row, only such as can link by what both share with a
pivot of their list.

Defined results: a NULL or empty text has no shingle, links with nothing and is
its own component. Rows with a NULL id are returned with a NULL component and
link with nothing. Rows that repeat an id come back as often as they came.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalake.llm.common import arrow_batch, scratch, stored, text_slices, texts_of
from annalake.llm.components import components
from annalake.llm.shingles import WIDTH, mix, seeded, set_digest, sets, shingles, words

#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Hashed counters of shingles, and how many of them travel as one row.
COUNTER_BITS = 23
COUNTERS, BLOCK = 1 << COUNTER_BITS, 1 << 15
#: Seeds of the global orders; the first one makes candidates, the others filter them.
ORDERS = (11, 23, 37)
#: Rows of a posting list that are held against a pivot before they are paired, and
#: words of 64 bits for the shingles in which a set and its pivot differ.
PIVOT_LIST, WORDS_OF_BITS = 16, 8
#: A list is crowded with more pairs a row than this, or with more rows than are paired to
#: count them; how many pairs, and how many rows of lists, are looked at in one go.
CROWDED, COUNTED_LIST, SQUARE, LIST_ROWS = 4, 2048, 1 << 18, 1 << 16
#: Bits of the sieve for ids, and how many partial ones the driver joins.
SIEVE, SIEVE_PARTS = 1 << 23, 8
_U = np.uint64


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(64 - COUNTER_BITS)).astype(np.int64)


def prefix(own: np.ndarray, levels: np.ndarray, seed: int, percent: int = PERCENT) -> np.ndarray:
    """The shingles of a sorted set that come first under an order: one of them
    at least is in any other set that links with it, and so among its own first."""
    rank = (levels[_counter(own)].astype(_U) << _U(58)) | (seeded(own, seed) >> _U(6))
    return own[np.argsort(rank, kind="stable")[: len(own) - (percent * len(own) + 99) // 100 + 1]]


def _describe(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A row for each document (doc_id, text_hash, node, n, spread), and of all counters blocks."""
    counts, waiting, held = np.zeros(COUNTERS, np.uint16), [], 0
    types = {"doc_id": pa.int64(), "text_hash": pa.int64(), "node": pa.int64(), "n": pa.int64(), "spread": pa.binary(), "block": pa.int32(), "counts": pa.binary()}

    def add() -> None:
        found, n = np.unique(np.concatenate(waiting), return_counts=True)
        counts[found] = np.minimum(counts[found] + n, 65535)  # orders need no more than that

    for batch in text_slices(batches):
        found = sets(batch.column("text"), width)
        rows = len(found)
        yield arrow_batch({"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "node": [set_digest(s) if len(s) else None for s in found], "n": [len(s) for s in found], "spread": [spread(s) for s in found], "block": [None] * rows, "counts": [None] * rows}, types)
        waiting.extend(map(_counter, found))
        held += sum(map(len, found))
        if held > 1 << 20:
            add()
            waiting, held = [], 0
    if held:
        add()
    for block in range(COUNTERS // BLOCK):
        part = counts[block * BLOCK : (block + 1) * BLOCK]
        if part.any():
            yield arrow_batch({"doc_id": [None], "text_hash": [None], "node": [None], "n": [None], "spread": [None], "block": [block], "counts": [pa.compress(part.tobytes(), "zstd", asbytes=True)]}, types)


def spread(own: np.ndarray) -> bytes:
    """How many shingles of a set fall into each of its buckets, about four into one."""
    buckets = 1 << max(4, min(16, int(len(own)).bit_length() - 3))
    return np.bincount((own & _U(buckets - 1)).astype(np.int64), minlength=buckets).astype(np.uint16).tobytes()


def at_most(x: bytes, y: bytes) -> int:
    """No two sets spread like this have more shingles in common."""
    a, b = np.frombuffer(x, np.uint16).astype(np.int64), np.frombuffer(y, np.uint16).astype(np.int64)
    buckets = min(len(a), len(b))
    return int(np.minimum(a.reshape(-1, buckets).sum(axis=0), b.reshape(-1, buckets).sum(axis=0)).sum())


def _add_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            part = np.frombuffer(pa.decompress(counts, 2 * BLOCK, "zstd", asbytes=True), np.uint16)
            total[block] = total.get(block, 0) + part.astype(np.int64)
    for block, counts in total.items():
        yield arrow_batch({"block": [block], "counts": [counts.tobytes()]}, {"block": pa.int32(), "counts": pa.binary()})


def _levels(blocks: DataFrame, folder: str) -> np.ndarray:
    """How often each counter's shingles are met, in powers of two above the
    mean: a byte for each counter, whatever the corpus."""
    summed = stored(blocks.repartition("block").mapInArrow(_add_blocks, "block int, counts binary"), folder)
    mean = max(summed.select("counts").mapInArrow(_total, "n long").agg(F.sum("n")).first()[0] or 0, COUNTERS / 2) / COUNTERS

    def leveled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = [np.clip(np.floor(np.log2(np.maximum(np.frombuffer(c, np.int64), 1) / mean)), 0, 31).astype(np.uint8).tobytes() for c in batch.column("counts").to_pylist()]
            yield arrow_batch({"block": batch.column("block"), "levels": levels}, {"block": pa.int32(), "levels": pa.binary()})

    levels = np.zeros(COUNTERS, np.uint8)
    for row in summed.mapInArrow(leveled, "block int, levels binary").collect():
        levels[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["levels"], np.uint8)
    return levels


def _total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield arrow_batch({"n": [int(np.frombuffer(c, np.int64).sum()) for c in batch.column("counts").to_pylist()]}, {"n": pa.int64()})


def _postings(batches: Iterable[pa.RecordBatch], levels: Broadcast, width: int) -> Iterator[pa.RecordBatch]:
    """(token, node, n, at) of the first order's prefixes; a set that a task meets again posts nothing."""
    seen: set[int] = set()
    types = {"token": pa.int64(), "node": pa.int64(), "n": pa.int32(), "at": pa.int32()}
    for batch in text_slices(batches):
        tokens, nodes, sizes, places = [], [], [], []
        for own in sets(batch.column("text"), width):
            if not len(own) or (node := set_digest(own)) in seen:
                continue
            seen.add(node)
            first = prefix(own, levels.value, ORDERS[0])
            tokens.append(first.view(np.int64))
            nodes.append(np.full(len(first), node, np.int64))
            sizes.append(np.full(len(first), len(own), np.int32))
            places.append(np.arange(len(first), dtype=np.int32))
        if tokens:
            yield arrow_batch({"token": np.concatenate(tokens), "node": np.concatenate(nodes), "n": np.concatenate(sizes), "at": np.concatenate(places)}, types)


def _possible(n: Column, at: Column, m: Column, where: Column) -> Column:
    """Size and positional bounds of a pair that has one shingle at these places."""
    union_share = F.lit(PERCENT) * (n + m)
    return (F.lit(100) * F.least(n, m) >= F.lit(PERCENT) * F.greatest(n, m)) & (F.least(n - at, m - where) * (100 + PERCENT) >= union_share)


def possible(n: np.ndarray, at: np.ndarray, m: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The same for arrays of numbers."""
    return (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & (np.minimum(n - at, m - where) * (100 + PERCENT) >= PERCENT * (n + m))


def partnered(token: np.ndarray, n: np.ndarray, at: np.ndarray, through: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of whole lists, ordered by token: whether a row may pair with
    another one of its list, and whether its list is crowded. Lists that are too
    long to be counted, and the one with token ``through``, keep all rows."""
    rows = len(token)
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    sizes = np.diff(np.append(first, rows))
    uncounted = (sizes > COUNTED_LIST) | (token[first] == through if through is not None else False)
    after = np.repeat(first + sizes, sizes) - np.arange(rows) - 1
    kept, pairs = np.repeat(uncounted, sizes), np.zeros(rows, np.int64)
    step, x = 1, np.flatnonzero(np.repeat((sizes < PIVOT_LIST) & ~uncounted, sizes) & (after > 0))
    while len(x):
        y = x + step
        ok = possible(n[x], at[x], n[y], at[y])
        kept[x[ok]] = kept[y[ok]] = True
        pairs[x] += ok
        step += 1
        x = x[after[x] >= step]
    for k in np.flatnonzero((sizes >= PIVOT_LIST) & ~uncounted):
        own, places = (c[first[k] : first[k] + sizes[k]] for c in (n, at))
        for a in range(0, len(own), SQUARE // len(own)):
            b = min(len(own), a + SQUARE // len(own))
            ok = possible(own[a:b, None], places[a:b, None], own, places)
            ok[np.arange(b - a), np.arange(a, b)] = False
            kept[first[k] + a : first[k] + b] = ok.any(axis=1)
            pairs[first[k] + a : first[k] + b] = ok.sum(axis=1)
    halves = np.where(sizes >= PIVOT_LIST, 1, 2)  # in long lists both rows of a pair count it
    left = np.add.reduceat(kept, first, dtype=np.int64)
    return kept, np.repeat(uncounted | (halves * np.add.reduceat(pairs, first) > 2 * CROWDED * left), sizes)


def _partnered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that ``partnered`` keeps of lists that come ordered by token."""
    waiting, held, through = [], 0, None

    def judged(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if len(rows):
            kept, crowded = partnered(*(rows.column(c).to_numpy().astype(np.int64) for c in ("token", "n", "at")), through)
            for batch in rows.append_column("crowded", pa.array(crowded)).filter(pa.array(kept)).combine_chunks().to_batches(LIST_ROWS):
                yield batch

    for batch in batches:
        waiting.append(batch)
        held += len(batch)
        if held < LIST_ROWS:
            continue
        rows = pa.Table.from_batches(waiting)
        token = rows.column("token").to_numpy()
        end = int(np.flatnonzero(token != token[-1])[-1]) + 1 if token[0] != token[-1] else 0
        if not end:  # one list with so many rows: they pass as they come
            through, end = int(token[0]), len(rows)
        yield from judged(rows.slice(0, end))
        waiting, held = rows.slice(end).to_batches(), len(rows) - end
    if held:
        yield from judged(pa.Table.from_batches(waiting))


def _neighbours(lists: DataFrame, order: list[Column]) -> DataFrame:
    """Pairs of rows that follow each other in a posting list."""
    w = W.partitionBy("token").orderBy(*order)
    before = lists.withColumns({"b": F.lag("node").over(w), "m": F.lag("n").over(w), "where": F.lag("at").over(w)})
    pairs = before.where(F.col("b").isNotNull() & _possible(F.col("n"), F.col("at"), F.col("m"), F.col("where")))
    return pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))


def _bits(some: np.ndarray) -> tuple[np.ndarray, int]:
    """A few shingles as bits, and how many of them fell on a bit that was set already."""
    places = (seeded(some, 71) & _U(64 * WORDS_OF_BITS - 1)).astype(np.int64)
    bits = np.zeros(WORDS_OF_BITS, _U)
    np.bitwise_or.at(bits, places >> 6, _U(1) << (places & 63).astype(_U))
    return bits.view(np.int64), len(some) - int(np.bitwise_count(bits).sum())


def against(own: np.ndarray, pivot: np.ndarray) -> dict[str, object]:
    """A set seen from a pivot: what they share, what it has besides and what it lacks.

    Of two sets seen from one pivot, at most
    shared(x) - lacks(y) + both lack + both have besides are in both of them.
    """
    besides, lacking = np.setdiff1d(own, pivot, assume_unique=True), np.setdiff1d(pivot, own, assume_unique=True)
    (more, more_again), (less, less_again) = _bits(besides), _bits(lacking)
    return {"shared": len(own) - len(besides), "lacks": len(lacking), "more_again": more_again, "less_again": less_again, "more": more, "less": less}


_COUNTS = ("shared", "lacks", "more_again", "less_again")
_MORE, _LESS = ([f"{side}{i}" for i in range(WORDS_OF_BITS)] for side in ("more", "less"))
_SEEN = [*_COUNTS, *_MORE, *_LESS]


def _views(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(node, pivot, what ``against`` tells) of pairs with their texts."""
    types = {"node": pa.int64(), "pivot": pa.int64(), **dict.fromkeys(_COUNTS, pa.int32()), **dict.fromkeys([*_MORE, *_LESS], pa.int64())}
    for batch in batches:
        known = _sets_of(batch, ("node", "pivot"), ("text_a", "text_b"), width)
        pairs = list(zip(batch.column("node").to_pylist(), batch.column("pivot").to_pylist(), strict=True))
        found = [against(known[node], known[pivot]) for node, pivot in pairs]
        columns = {"node": [p[0] for p in pairs], "pivot": [p[1] for p in pairs], **{c: [f[c] for f in found] for c in _COUNTS}}
        for side, names in (("more", _MORE), ("less", _LESS)):
            columns |= {name: [f[side][i] for f in found] for i, name in enumerate(names)}
        yield arrow_batch(columns, types)


def _other_component(rows: DataFrame, key: str, carried: list[str]) -> DataFrame:
    """Pairs of rows with one key and different labels, one side without the key's
    commonest label; the columns of the other side end in _b."""
    sizes = rows.groupBy(key, "label").agg(F.count(F.lit(1)).alias("size"))
    common = sizes.groupBy(key).agg(F.max(F.struct("size", "label")).getField("label").alias("common"))
    rows = rows.join(common, key)
    right = rows.select(key, *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "label", *carried)], (F.col("label") == F.col("common")).alias("is_common"))
    pairs = rows.where("label <> common").select(key, "node", "n", "label", *carried).join(right, key)
    return pairs.where((F.col("label") != F.col("label_b")) & (F.col("is_common") | (F.col("node") < F.col("node_b"))))


def _between(lists: DataFrame, labels: DataFrame, edges: DataFrame, classes: DataFrame, texts: DataFrame, width: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """Candidates of different components, and links found on the way. One side
    leaves out the commonest component, so that what is paired is small even where
    that component has most of a long list.

    The rows of a crowded list of ``PIVOT_LIST`` or more are first held against one of
    them, the pivot, which is linear; lists with one pivot are one. What two sets share
    with it, lack of it and have besides, as counts and bits, bounds what they have
    in common. So the many texts that stand around a common one just below the
    threshold aren't candidates of each other.
    """
    placed = lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = placed.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("rows")).where("low <> high").select("token", "rows")
    placed = stored(placed.join(mixed, "token"), f"{folder}/mixed")
    pivoted = (F.col("rows") >= PIVOT_LIST) & F.col("crowded")
    few = _other_component(placed.where(~pivoted), "token", ["at"])
    few = few.where(_possible(F.col("n"), F.col("at"), F.col("n_b"), F.col("at_b")))

    long = placed.where(pivoted)
    degree = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    best = F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), "node")).getField("node")
    pivots = long.join(degree, "node", "left").groupBy("token").agg(best.alias("pivot"))
    asked = stored(long.join(pivots, "token").select("node", "pivot", "n", "label").distinct(), f"{folder}/asked")
    found = _fetched(asked.select("node").union(asked.select("pivot")).distinct(), classes, texts, width, f"{folder}/asked-of")
    joined = asked.join(found.withColumnRenamed("text", "text_a"), "node").join(found.select(F.col("node").alias("pivot"), F.col("text").alias("text_b")), "pivot")
    schema = ", ".join(["node long, pivot long", *[f"{c} int" for c in _COUNTS], *[f"{c} long" for c in [*_MORE, *_LESS]]])
    views = joined.select("node", "pivot", "text_a", "text_b").mapInArrow(lambda x: _views(x, width), schema)
    views = stored(views.join(asked, ["node", "pivot"]), f"{folder}/views")

    def both(names: list[str], again: str) -> Column:
        return sum((F.bit_count(F.col(c).bitwiseAND(F.col(f"{c}_b"))) for c in names), F.least(again, f"{again}_b"))

    def enough(most: Column, n: Column, m: Column) -> Column:
        return most * (100 + PERCENT) >= F.lit(PERCENT) * (n + m)

    many = _other_component(views, "pivot", _SEEN)
    most = F.col("shared") - F.col("lacks_b") + both(_LESS, "less_again") + both(_MORE, "more_again")
    many = many.where((F.lit(100) * F.least("n", "n_b") >= F.lit(PERCENT) * F.greatest("n", "n_b")) & enough(most, F.col("n"), F.col("n_b")))
    close = views.where((F.col("node") != F.col("pivot")) & enough(F.col("shared"), F.col("n"), F.col("shared") + F.col("lacks")))
    pairs = _ordered(few, "node", "node_b").union(_ordered(many, "node", "node_b"))
    return pairs, stored(_ordered(close, "node", "pivot").distinct(), f"{folder}/close")


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values have in common."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def links(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    both = _shared(x, y)
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _sets_of(batch: pa.RecordBatch, names: tuple[str, str], columns: tuple[str, str], width: int) -> dict[int, np.ndarray]:
    """The sets of all nodes of a batch of pairs. Each text is read once."""
    first: dict[int, tuple[int, int]] = {}
    for side, name in enumerate(names):
        for row, node in enumerate(batch.column(name).to_pylist()):
            first.setdefault(node, (side, row))
    known: dict[int, np.ndarray] = {}
    for side, column in enumerate(columns):
        wanted = [(node, row) for node, (of, row) in first.items() if of == side]
        texts = pa.RecordBatch.from_arrays([pa.array([node for node, _ in wanted], pa.int64()), batch.column(column).take(pa.array([row for _, row in wanted], pa.int64()))], names=["node", "text"])
        for part in text_slices([texts]):
            known.update(zip(part.column("node").to_pylist(), sets(part.column("text"), width), strict=True))
    return known


def _verify(batches: Iterable[pa.RecordBatch], levels: Broadcast, width: int) -> Iterator[pa.RecordBatch]:
    """The pairs that share prefixes under all further orders, and then link."""
    for batch in batches:
        known = {node: (own, [np.sort(prefix(own, levels.value, seed)) for seed in ORDERS[1:]]) for node, own in _sets_of(batch, ("a", "b"), ("text_a", "text_b"), width).items()}
        kept = []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            (x, firsts), (y, others) = known[a], known[b]
            if all(_shared(p, q) for p, q in zip(firsts, others, strict=True)) and links(x, y):
                kept.append((a, b))
        yield arrow_batch({"a": [k[0] for k in kept], "b": [k[1] for k in kept]}, {"a": pa.int64(), "b": pa.int64()})


def _promising(pairs: DataFrame, classes: DataFrame, folder: str) -> DataFrame:
    """Pairs whose sets can have enough in common, judged by how they spread over buckets."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    spreads = classes.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("n").alias("n"), F.min("spread").alias("spread"))
    spreads = stored(spreads, f"{folder}/spreads")

    def enough(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (batch.column(c).to_pylist() for c in ("n", "m", "x", "y"))
            keep = [at_most(p, q) * (100 + PERCENT) >= PERCENT * (i + j) for i, j, p, q in zip(n, m, x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = spreads.select(F.col("node").alias("a"), "n", F.col("spread").alias("x"))
    right = spreads.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("spread").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(enough, "a long, b long")


def _sieve(ids: DataFrame) -> np.ndarray:
    """Bits that are set for all ids; a fixed size, so it may let others through."""

    def bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(SIEVE, bool)
        for batch in batches:
            found[_places(np.array(batch.column("doc_id")))] = True
        yield arrow_batch({"bits": [np.packbits(found).tobytes()]}, {"bits": pa.binary()})

    parts = ids.select("doc_id").repartition(SIEVE_PARTS).mapInArrow(bits, "bits binary").collect()
    total = np.zeros(SIEVE // 8, np.uint8)
    for row in parts:
        total |= np.frombuffer(row["bits"], np.uint8)
    return np.unpackbits(total).astype(bool)


def _places(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(_U)) & _U(SIEVE - 1)).astype(np.int64)


def _fetched(nodes: DataFrame, classes: DataFrame, texts: DataFrame, width: int, folder: str) -> DataFrame:
    """(node, text) of some nodes. Only their texts are shuffled."""
    holders = stored(classes.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")), f"{folder}/holders")
    sieve = texts.sparkSession.sparkContext.broadcast(_sieve(holders))

    def sifted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sieve.value[_places(np.array(batch.column("doc_id")))], pa.bool_()))

    found = texts.mapInArrow(sifted, "doc_id long, text string").join(holders, "doc_id")

    def named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An id may stand at several texts; the node's own text has its digest."""
        for batch in text_slices(batches):
            own = [len(s) > 0 and set_digest(s) == node for s, node in zip(sets(batch.column("text"), width), batch.column("node").to_pylist(), strict=True)]
            yield batch.select(["node", "text"]).filter(pa.array(own, pa.bool_()))

    found = found.select("doc_id", "node", "text").mapInArrow(named, "node long, text string").dropDuplicates(["node"])
    return stored(found, f"{folder}/texts")


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, levels: Broadcast, width: int, folder: str) -> DataFrame:
    """Of candidate pairs of nodes those that link. Only texts of promising candidates are shuffled."""
    pairs = stored(_promising(stored(pairs.distinct(), f"{folder}/candidates"), classes, folder), f"{folder}/pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    found = _fetched(wanted, classes, texts, width, folder)
    joined = pairs.join(found.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(found.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return stored(joined.mapInArrow(lambda x: _verify(x, levels, width), "a long, b long"), f"{folder}/edges")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) and
    text_hash (xxhash64 of the text) for each row of ``docs``."""
    spark = docs.sparkSession
    folder = scratch(spark)
    texts = texts_of(docs, id_col, text_col)
    hashed = texts.withColumn("text_hash", F.xxhash64("text"))
    described = stored(hashed.mapInArrow(lambda x: _describe(x, width), "doc_id long, text_hash long, node long, n long, spread binary, block int, counts binary"), f"{folder}/described")
    rows = described.where("block IS NULL").select("doc_id", "text_hash", "node", "n")
    classes = described.where("block IS NULL AND doc_id IS NOT NULL AND node IS NOT NULL").select("doc_id", "node", "n", "spread")
    levels = spark.sparkContext.broadcast(_levels(described.where("block IS NOT NULL").select("block", "counts"), f"{folder}/counters"))

    usable = texts.where("doc_id IS NOT NULL")
    posted = usable.mapInArrow(lambda x: _postings(x, levels, width), "token long, node long, n int, at int")
    in_list = W.partitionBy("token")
    by_size = in_list.orderBy("n", "node")
    whole = by_size.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    lists = posted.withColumns({"first": F.min("node").over(whole), "last": F.max("node").over(whole), "before": F.lag("node").over(by_size)})
    lists = lists.where("first <> last AND (before IS NULL OR before <> node)").select("token", "node", "n", "at")
    lists = lists.sortWithinPartitions("token", "n", "node")
    lists = stored(lists.mapInArrow(_partnered, "token long, node long, n int, at int, crowded boolean"), f"{folder}/lists")

    near = _neighbours(lists, [F.col("n"), F.col("node")]).union(_neighbours(lists, [F.xxhash64("node", "token"), F.col("node")]))
    first_edges = _verified(near, classes, usable, levels, width, f"{folder}/near")
    first_labels = components(first_edges, f"{folder}/first")
    across, close = _between(lists, first_labels, first_edges, classes, usable, width, f"{folder}/between")
    more_edges = _verified(across, classes, usable, levels, width, f"{folder}/across").unionByName(close)
    if more_edges.isEmpty():
        labels = first_labels
    else:
        labels = components(first_edges.unionByName(more_edges), f"{folder}/second")

    smallest = classes.groupBy("node").agg(F.min("doc_id").alias("smallest"))
    smallest = smallest.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = smallest.groupBy("label").agg(F.min("smallest").alias("component_id"))
    by_node = smallest.join(named, "label").select(F.col("node").alias("of_node"), "component_id")
    out = rows.join(by_node, F.when(F.col("doc_id").isNotNull(), F.col("node")) == F.col("of_node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "text_hash")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` without those that link, in the end, with a smaller
    id, with all their columns. Of rows that repeat an id and its text one stays.
    Rows without words or without an id all stay."""
    found = stored(jaccard_components(docs, id_col, text_col, width).where("n_shingles > 0 AND doc_id IS NOT NULL"), f"{scratch(docs.sparkSession)}/found")

    def own(of: DataFrame) -> Column:
        """Columns are taken from their frames: the documents may have any names."""
        return (docs[f"`{id_col}`"].cast("long") == of["doc_id"]) & (F.xxhash64(docs[f"`{text_col}`"].cast("string")) == of["text_hash"])

    gone = found.where("doc_id <> component_id").select("doc_id", "text_hash").distinct()
    left = docs.join(gone, own(gone), "left_anti")
    again = found.where("doc_id = component_id").groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash")
    if again.isEmpty():
        return left
    repeated = left.join(again, own(again), "left_semi").dropDuplicates([id_col, text_col])
    return left.join(again, own(again), "left_anti").unionByName(repeated)


def oracle() -> str:
    """The same by counting the shingles that every two documents share."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    shingled AS MATERIALIZED (
      SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' ')) END) AS s FROM words)),
    sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS MATERIALIZED (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * o >= {PERCENT} * (p.n + q.n - o)),
    edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    walk(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT w.doc_id, e.y FROM walk w JOIN edges e ON e.x = w.reached)
    SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(reached) AS component_id
    FROM walk w LEFT JOIN sizes s ON s.doc_id = w.doc_id GROUP BY w.doc_id, n"""
