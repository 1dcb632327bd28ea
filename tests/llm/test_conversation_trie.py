"""The prefix trie against a brute-force one, for any size of shards."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalake.llm import conversation_trie as ct

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append((turn, role or "", text or ""))

    def order(t):
        digest = hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest()
        return (t[0] is not None, t[0] or 0, digest)

    own = {c: [t[1:] for t in sorted(turns, key=order)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    nodes = {}
    for c, path in whole.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    found = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[:-1] == p for q in nodes)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in members if whole[c] == path)))
        parent = min(nodes[path[:-1]]) if path else None
        children = sum(len(p) == len(path) + 1 for p in below)
        found.append((min(members), len(path), parent, len(members), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=repr)


def conversations(seed, n=60, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), n):
        same = rng.random() < 0.4
        for turn in range(rng.randrange(1, longest)):
            text = f"t{turn}" if same else rng.choice("xyz") * rng.randrange(1, 4)
            rows.append((c, None if rng.random() < 0.03 else turn, rng.choice(["user", "bot"]) if not same else "user", text if rng.random() > 0.05 else None))
    rows += [(0, t, "user", f"deep{t}") for t in range(40)]
    rows += [(c, t, "user", "copy") for c in range(500, 540) for t in range(7)]
    rows += [(None, 1, "user", "nobody"), (7, 0, None, None), (7, 0, None, None)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


@pytest.mark.parametrize("shard", [1, 12, 60, 1 << 16])
def test_equals_brute_force(spark, shard):
    rows = conversations(shard)
    df = frame(spark, rows).withColumns({c: F.lit(c) for c in ("node", "depth", "length", "n", "h", "parent", "pos", "under")})
    found = ct.prefix_trie(df, shard=shard)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_empty_and_turnless(spark):
    assert ct.prefix_trie(frame(spark, [])).collect() == []
    assert ct.prefix_trie(frame(spark, [(None, 0, "user", "x")])).collect() == []
    # Three turns are replaced by those of a conversation that isn't there.
    turnless = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 3)
    rows = [(turnless, t, "user", "x") for t in range(2)]
    assert [tuple(r) for r in ct.prefix_trie(frame(spark, rows)).collect()] == brute(rows)
    assert brute(rows)[0][:6] == (turnless, 0, None, 1, 0, 1)


def test_long_texts(spark):
    rows = [(c, t, "user", "long " * 50_000 + str(t)) for c in (1, 2, 3) for t in range(8)]
    assert sorted(map(tuple, ct.prefix_trie(frame(spark, rows)).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("block", [1, 2, 7, 64])
def test_findclose_equals_a_stack(block):
    rng = random.Random(block)
    for size in (1, 2, 30, 500):
        bits, open_ = [], 0
        while len(bits) < size or open_:
            up = not open_ or (len(bits) < size and rng.random() < 0.55)
            bits.append(up)
            open_ += 1 if up else -1
        stack, close = [], {}
        for at, bit in enumerate(bits):
            if bit:
                stack.append(at)
            else:
                close[stack.pop()] = at
        tree = ct.Parentheses(np.array(bits), block)
        assert tree.findclose(tree.opens).tolist() == [close[i] for i in tree.opens]


def test_range_minimum():
    values = np.random.default_rng(1).integers(0, 99, 37)
    low = ct.RangeMin(values)
    pairs = [(a, b) for a in range(37) for b in range(a + 1, 38)]
    start, stop = np.array(pairs).T
    assert low.of(start, stop).tolist() == [values[a:b].min() for a, b in pairs]


def test_digest_of_many_ends_in_small_blocks(spark):
    ends = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN X'01' ELSE X'02' END AS node", "id AS conv_id").repartition(5)
    found = {bytes(r.node): r.ends_sha256 for r in ct.ends_digest(ends, block=7).collect()}
    ids = {b"\1": range(0, 3000, 3), b"\2": [i for i in range(3000) if i % 3]}
    assert found == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in ids.items()}
