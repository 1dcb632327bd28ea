"""The prefix trie of conversations: who shares which first turns, and what it saves.

A node is a distinct sequence of first turns. Its id is a chain of SHA-256 over the
turns, so equal sequences have equal ids wherever they are computed.

* Conversations that are equal as a whole are folded to one sequence with a count.
* Nodes with more than ``SHARD`` turns at or below them, and the root, are the spine.
  What hangs below a spine node falls into shards, the subtrees of its other
  children, each bounded by ``SHARD``.
* A task takes the sorted sequences of some shards and writes their tries as balanced
  parentheses. Excess is kept with the minima of blocks in a min tree; ``findclose``
  delimits the subtree of every node. The leaves below a node are the pairs ``()``
  between its parentheses, counted by rank; members and savings are differences
  of cumulative arrays, the smallest member is a range minimum.
* Spines that shards share are merged: what shards hand up is summed by spine node,
  and the sums go up the spine by pointer doubling, a round for each bit of its depth.
* The digest of a node's ends reads ids in order. They are sorted over all tasks and
  joined to text there, so that even a third of all conversations ending in one node
  reach the one task that hashes them as a few blocks, one at a time.

Defined results: turns of equal number are ordered by their content's digest, and
repeated rows are turns of their own. Turns without a conversation are left out. An
empty table has no nodes, not even a root. Other columns are neither read nor kept.
The turns of one conversation are numbered and chained by one task, which streams
them; it holds none of their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalake.llm.common import arrow_batch, scratch, stored
from annalake.operators.matching import absent_from

#: Turns at or below a node from which on it belongs to the spine.
SHARD = 1 << 16
#: Conversations of a group, and the bound of the turns that they share.
GROUP = 100
SHARED = 6
#: Ids in a block of text that is hashed at once.
ID_BLOCK = 1 << 14
#: Parentheses in a block of the min tree.
BLOCK = 256
_ROOT = hashlib.sha256(b"").digest()[:16]


# -- turns ----------------------------------------------------------------------


def rebuild(turns: DataFrame, group: int = GROUP, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """Every conversation with the first turns of its group's first one in place of
    its own: (conv_id, length), and (conv_id, length, depth, digest, chars)."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    given = turns.select(
        F.col("`conv_id`").cast("long").alias("conv_id"),
        F.col("`turn`").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.char_length(text).alias("chars"),
    ).where("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    numbered = given.withColumn("pos", F.row_number().over(order)).drop("turn")

    own = F.col("conv_id")
    sizes = numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = sizes.select("conv_id", "n", (own - own % group).alias("base"), (F.crc32(own.cast("string")) % shared).alias("h"))
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = convs.join(base, "base", "left").withColumn("taken", taken)
    convs = convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))

    rest = numbered.join(convs, "conv_id").where("pos > h").withColumn("depth", F.col("taken") + F.col("pos") - F.col("h"))
    first = numbered.where((own % group == 0) & (F.col("pos") < shared)).select(own.alias("base"), "pos", "digest", "chars")
    start = convs.join(first, "base").where("pos <= taken").withColumn("depth", F.col("pos"))
    columns = ["conv_id", F.col("length").cast("long"), F.col("depth").cast("long"), "digest", F.col("chars").cast("long")]
    return convs.select("conv_id", F.col("length").cast("long")), rest.select(*columns).unionByName(start.select(*columns))


def _chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds node and parent to turns in order of conversation and depth."""
    current, node = None, _ROOT
    for batch in batches:
        nodes, parents = [], []
        for conv_id, digest in zip(batch.column("conv_id").to_pylist(), batch.column("digest").to_pylist(), strict=True):
            if conv_id != current:
                current, node = conv_id, _ROOT
            parents.append(node)
            node = hashlib.sha256(node + digest).digest()[:16]
            nodes.append(node)
        kept = [batch.column(c) for c in ("conv_id", "length", "depth", "chars")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(nodes, pa.binary()), pa.array(parents, pa.binary())], names=["conv_id", "length", "depth", "chars", "node", "parent"])


# -- balanced parentheses -------------------------------------------------------


class Parentheses:
    """A forest as balanced parentheses with a min tree over blocks of excess."""

    def __init__(self, bits: np.ndarray, block: int = BLOCK) -> None:
        self.bits, self.block = bits, block
        self.excess = np.cumsum(np.where(bits, 1, -1), dtype=np.int64)
        self.opens = np.flatnonzero(bits)
        #: Opening parentheses, and pairs "()", before each place.
        self.rank = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        self.leaf_rank = np.concatenate([[0], np.cumsum(bits & ~np.append(bits[1:], True), dtype=np.int64)])
        blocks = -(-len(bits) // block)
        self.leaves = 1 << max(blocks - 1, 0).bit_length()
        padded = np.full(self.leaves * block, np.iinfo(np.int64).max)
        padded[: len(bits)] = self.excess
        self.rows = padded.reshape(self.leaves, block)
        self.tree = np.empty(2 * self.leaves, np.int64)
        self.tree[self.leaves :] = self.rows.min(axis=1)
        for at in range(self.leaves - 1, 0, -1):
            self.tree[at] = min(self.tree[2 * at], self.tree[2 * at + 1])

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each of some opening ones: the next place with less excess."""
        return np.concatenate([self._close(at[k : k + 4096]) for k in range(0, len(at), 4096)] or [np.zeros(0, np.int64)])

    def _close(self, at: np.ndarray) -> np.ndarray:
        least, where = self.excess[at] - 1, at // self.block
        inside = (self.rows[where] <= least[:, None]) & (np.arange(self.block) > (at % self.block)[:, None])
        found = where * self.block + inside.argmax(axis=1)
        open_ = np.flatnonzero(~inside.any(axis=1))
        if len(open_):
            # Up until a right sibling reaches that low, then down to its first such block.
            node, low = where[open_] + self.leaves, least[open_]
            climbing = np.ones(len(open_), bool)
            while climbing.any():
                right = (node % 2 == 0) & (self.tree[np.minimum(node + 1, len(self.tree) - 1)] <= low)
                node = np.where(climbing, np.where(right, node + 1, node // 2), node)
                climbing &= ~right
            while (node < self.leaves).any():
                left = 2 * node
                below = np.where(self.tree[np.minimum(left, len(self.tree) - 1)] <= low, left, left + 1)
                node = np.where(node < self.leaves, below, node)
            where = node - self.leaves
            found[open_] = where * self.block + (self.rows[where] <= low[:, None]).argmax(axis=1)
        return found


class RangeMin:
    """Smallest value of any range of an array."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        level = np.frexp((stop - start).astype(float))[1] - 1
        found = np.empty(len(start), self.levels[0].dtype)
        for k in np.unique(level):
            own = level == k
            found[own] = np.minimum(self.levels[k][start[own]], self.levels[k][stop[own] - (1 << k)])
        return found


def trie_of(ids: np.ndarray, chars: np.ndarray, lengths: np.ndarray, convs: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """The nodes of sorted distinct sequences in preorder.

    ``ids`` (two words each) and ``chars`` are those of all sequences one after the
    other. ``at`` is a node's place in them, ``parent`` the preorder number of the node
    above it or -1, ``level`` its depth from 0.
    """
    starts = np.cumsum(lengths) - lengths
    both = np.minimum(lengths[:-1], lengths[1:])
    step = np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both)
    same = (ids[np.repeat(starts[:-1], both) + step] == ids[np.repeat(starts[1:], both) + step]).all(axis=1)
    # Ids are chains: what follows a difference differs.
    common = np.concatenate([[0], np.bincount(np.repeat(np.arange(len(both)), both), same, len(both)).astype(np.int64)])
    opened, closed = lengths - common, lengths - np.append(common[1:], 0)
    bits = np.repeat(np.tile([True, False], len(lengths)), np.stack([opened, closed], axis=1).ravel())
    tree = Parentheses(bits)
    opens, close = tree.opens, tree.findclose(tree.opens)
    sequence = np.repeat(np.arange(len(lengths)), opened)
    level = np.arange(len(opens)) - np.repeat(np.cumsum(opened) - opened, opened) + common[sequence]
    at = starts[sequence] + level

    first, last = tree.rank[opens], tree.rank[close]
    through = np.searchsorted(np.cumsum(opened), last, side="left") + 1
    ended = np.zeros(len(opens), np.int64)
    ended[np.cumsum(opened) - 1] = ends
    n_convs = np.diff(np.concatenate([[0], np.cumsum(ended)])[np.stack([first, last], axis=1)])[:, 0]
    saved = np.concatenate([[0], np.cumsum((n_convs - 1) * chars[at])])
    # Nodes of one level in order: children are those of the next between the parentheses.
    span = len(bits) + 1
    by_level = np.sort(level * span + opens)
    below, above = (level + 1) * span, (level - 1) * span
    n_children = np.searchsorted(by_level, below + close) - np.searchsorted(by_level, below + opens)
    parent = tree.rank[by_level[np.maximum(np.searchsorted(by_level, above + opens) - 1, 0)] % span]
    return {
        "at": at,
        "level": level,
        "parent": np.where(level > 0, parent, -1),
        "conv_id": RangeMin(convs).of(sequence, through),
        "n_convs": n_convs,
        "n_children": n_children,
        "n_leaves": tree.leaf_rank[close] - tree.leaf_rank[opens],
        "saved_tokens": saved[last] - saved[first],
    }


_NODES = {"node": pa.binary(), "under": pa.binary(), "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64()}
_NODES |= {c: pa.int64() for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")}
_NODES_SQL = "node binary, under binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _tries(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Nodes of the shards in sorted sequences, some whole shards at a time."""
    held: list[pa.RecordBatch] = []

    def nodes(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        paths = rows["path"].combine_chunks()
        lengths = pc.list_value_length(paths).to_numpy().astype(np.int64)
        turns = paths.flatten()
        names, depth = turns.field("node"), turns.field("depth").to_numpy()
        ids = np.frombuffer(b"".join(names.to_pylist()), np.uint64).reshape(-1, 2)
        found = trie_of(ids, turns.field("chars").to_numpy(), lengths, rows["conv_id"].to_numpy(), rows["n_ends"].to_numpy())
        at, parent, top = found.pop("at"), found.pop("parent"), found.pop("level") == 0
        # Only a sequence that begins a shard opens its top node.
        owner = np.searchsorted(np.cumsum(lengths), at, side="right")
        under = pc.if_else(pa.array(top), rows["under"].combine_chunks().take(pa.array(owner)), pa.scalar(None, pa.binary()))
        above = pa.array(found["conv_id"][parent], pa.int64(), mask=top)
        columns = {"node": names.take(pa.array(at)), "under": under, "depth": depth[at], "parent_conv_id": above, **found}
        yield arrow_batch({c: columns[c] for c in _NODES}, _NODES)

    turns = 0
    for batch in batches:
        shards = batch.column("shard")
        for part in _runs(batch, shards):
            if held and turns >= size and part.column("shard")[0] != held[-1].column("shard")[0]:
                yield from nodes(pa.Table.from_batches(held))
                held, turns = [], 0
            held.append(part)
            turns += len(part.column("path").flatten())
    if held:
        yield from nodes(pa.Table.from_batches(held))


def _runs(batch: pa.RecordBatch, keys: pa.Array) -> Iterator[pa.RecordBatch]:
    """Slices of a sorted batch with one key each."""
    codes = keys.dictionary_encode().indices.to_numpy()
    edges = np.flatnonzero(np.diff(codes, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


# -- ends -----------------------------------------------------------------------


def _blocks(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) as comma-joined blocks with their first id."""
    types = {"node": pa.binary(), "first": pa.int64(), "ids": pa.string()}
    for batch in batches:
        for run in _runs(batch, batch.column("node")):
            ids = run.column("conv_id").to_pylist()
            parts = [ids[k : k + size] for k in range(0, len(ids), size)]
            yield arrow_batch({"node": [run.column("node")[0].as_py()] * len(parts), "first": [p[0] for p in parts], "ids": [",".join(map(str, p)) for p in parts]}, types)


def _hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's blocks, which come in order."""
    types = {"node": pa.binary(), "ends_sha256": pa.string()}
    current, state = None, hashlib.sha256()
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if node == current:
                state.update(b"," + ids.encode())
                continue
            if current is not None:
                done.append((current, state.hexdigest()))
            current, state = node, hashlib.sha256(ids.encode())
        yield arrow_batch({"node": [d[0] for d in done], "ends_sha256": [d[1] for d in done]}, types)
    if current is not None:
        yield arrow_batch({"node": [current], "ends_sha256": [state.hexdigest()]}, types)


def ends_digest(ends: DataFrame, block: int = ID_BLOCK) -> DataFrame:
    """node, ends_sha256: of the ids that end in a node, ascending and comma-joined."""
    ordered = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    blocks = ordered.mapInArrow(lambda batches: _blocks(batches, block), "node binary, first long, ids string")
    return blocks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashes, "node binary, ends_sha256 string")


# -- the whole trie ---------------------------------------------------------------


def _spine_sums(spine: DataFrame, depth: int, folder: str) -> DataFrame:
    """(node, n_leaves, saved_tokens) of whole subtrees from what each of the nodes
    (node, up, n_leaves, saved_tokens) has of its own: after round k a node holds
    the sum over fewer than 2^k levels, and ``up`` is the node 2^k levels above."""
    for turn in range(int(depth).bit_length()):
        below = spine.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        further = spine.select(F.col("node").alias("up"), F.col("up").alias("further"))
        joined = spine.join(below, "node", "left").join(further, "up", "left")
        total: dict[str, Column] = {c: F.col(c) + F.coalesce(m, F.lit(0)) for c, m in (("n_leaves", "more_leaves"), ("saved_tokens", "more_saved"))}
        spine = stored(joined.select("node", F.col("further").alias("up"), *[v.alias(c) for c, v in total.items()]), f"{folder}/spine-{turn}")
    return spine.select("node", "n_leaves", "saved_tokens")


def prefix_trie(turns: DataFrame, group: int = GROUP, shared: int = SHARED, shard: int = SHARD) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 for each node of the rebuilt conversations of ``turns`` (conv_id,
    turn, role, text)."""
    spark, folder = turns.sparkSession, scratch(turns.sparkSession)
    convs, rows = rebuild(turns, group, shared)
    convs = stored(convs, f"{folder}/convs")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    paths = stored(ordered.mapInArrow(_chain, "conv_id long, length long, depth long, chars long, node binary, parent binary"), f"{folder}/paths")

    root = F.lit(_ROOT)
    every = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    top = every.select(root.alias("node"), F.lit(None).cast("binary").alias("up"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), "conv_id", "n_convs")
    node = paths.groupBy("node").agg(
        F.first("parent").alias("up"),
        F.first("depth").alias("depth"),
        F.first("chars").alias("chars"),
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("below"),
    )
    spine = stored(top.unionByName(node.where(F.col("below") > shard).drop("below")), f"{folder}/spine")

    ends = paths.where("depth = length").select("node", "conv_id").unionByName(convs.where("length = 0").select(root.alias("node"), "conv_id"))
    whole = ends.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_ends")).select("conv_id", "n_ends")
    light = absent_from(paths, spine, ["node"]).join(whole, "conv_id")
    turn = F.struct("depth", "node", "chars", "parent")
    sequences = light.groupBy("conv_id").agg(F.first("n_ends").alias("n_ends"), F.array_sort(F.collect_list(turn)).alias("path"))
    sequences = sequences.select("conv_id", "n_ends", F.col("path")[0]["node"].alias("shard"), F.col("path")[0]["parent"].alias("under"), F.transform("path", lambda t: F.struct(t["depth"].alias("depth"), t["node"].alias("node"), t["chars"].alias("chars"))).alias("path"))
    in_order = sequences.repartition("shard").sortWithinPartitions("shard", F.transform("path", lambda t: t["node"]))
    small = stored(in_order.mapInArrow(lambda batches: _tries(batches, shard), _NODES_SQL), f"{folder}/shards")

    handed = small.where("under IS NOT NULL").groupBy(F.col("under").alias("node"))
    handed = handed.agg(F.count(F.lit(1)).alias("tops"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    kin = spine.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("kin"))
    given = {c: F.coalesce(c, F.lit(0)) for c in ("tops", "kin", "n_leaves", "saved_tokens")}
    own = spine.join(handed, "node", "left").join(kin, "node", "left").withColumns(given).select(
        "node",
        "up",
        "depth",
        "conv_id",
        "n_convs",
        (F.col("tops") + F.col("kin")).alias("n_children"),
        (F.col("n_leaves") + F.when(F.col("tops") + F.col("kin") == 0, 1).otherwise(0)).alias("n_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    )
    own = stored(own, f"{folder}/own")
    deepest = own.agg(F.max("depth")).first()[0] or 0
    merged = own.drop("n_leaves", "saved_tokens").join(_spine_sums(own.select("node", "up", "n_leaves", "saved_tokens"), deepest, folder), "node")
    known = own.select(F.col("node").alias("under"), F.col("conv_id").alias("spine_conv"))
    large = merged.withColumn("under", F.col("up")).withColumn("parent_conv_id", F.lit(None).cast("long")).select(*_NODES)
    nodes = small.unionByName(large).join(known, "under", "left").join(ends_digest(ends), "node", "left")
    return nodes.select(
        "conv_id",
        "depth",
        F.coalesce("parent_conv_id", "spine_conv").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def oracle() -> str:
    """The registered query in SQL, by sequences themselves in place of ids. DuckDB has
    no CRC-32, so it is folded bit by bit over the digits."""
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda s, b: {step})"
    step = "xor(s, b)"
    for _ in range(8):
        step = f"list_transform([{step}], lambda v: xor(v >> 1, (v & 1) * 3988292384))[1]"
    crc = f"xor({crc.format(step=step)}, 4294967295)"
    return f"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || text)) AS pos FROM given),
sizes AS (SELECT conv_id, count(*) AS n, {crc} % 6 AS h FROM given GROUP BY conv_id),
convs AS (
  SELECT c.conv_id, c.conv_id - c.conv_id % 100 AS base, c.h, least(c.h, coalesce(b.n, 0)) AS taken
  FROM sizes c LEFT JOIN sizes b ON b.conv_id = c.conv_id - c.conv_id % 100),
turns AS (
  SELECT c.conv_id, c.taken + t.pos - c.h AS depth, t.role, t.text FROM convs c JOIN numbered t ON t.conv_id = c.conv_id AND t.pos > c.h
  UNION ALL
  SELECT c.conv_id, t.pos AS depth, t.role, t.text FROM convs c JOIN numbered t ON t.conv_id = c.base AND t.pos <= c.taken),
whole AS (
  SELECT conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY depth) FILTER (WHERE depth IS NOT NULL), []) AS path
  FROM convs LEFT JOIN turns USING (conv_id) GROUP BY conv_id),
prefixes AS (
  SELECT w.conv_id, len(w.path) AS length, d.depth, w.path[1:d.depth] AS path
  FROM whole w, LATERAL (SELECT unnest(generate_series(0, len(w.path))) AS depth) d),
nodes AS (
  SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = length), '')) AS ends_sha256
  FROM prefixes GROUP BY path),
kin AS (
  SELECT p.path, count(c.path) AS n_children
  FROM nodes p LEFT JOIN nodes c ON c.depth = p.depth + 1 AND c.path[1:p.depth] = p.path GROUP BY p.path),
valued AS (
  SELECT n.*, k.n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * length(n.path[n.depth].text) END AS saving
  FROM nodes n JOIN kin k ON k.path = n.path),
above AS (
  SELECT v.path AS low, v.path[1:d.depth] AS path, v.n_children, v.saving
  FROM valued v, LATERAL (SELECT unnest(generate_series(0, v.depth)) AS depth) d),
sums AS (
  SELECT path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saving)::BIGINT AS saved_tokens FROM above GROUP BY path)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
FROM valued v JOIN sums s ON s.path = v.path LEFT JOIN nodes p ON p.depth = v.depth - 1 AND p.path = v.path[1:v.depth - 1] AND v.depth > 0"""
