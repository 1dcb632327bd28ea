"""Joins and searches against brute force over all pairs."""

import random
import re
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annalake.llm import decontamination, hilbert_neighbours, jaccard_join, licenses, shingles
from tests_llm_common import ascii_lower, sentence

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def word_shingles(text, words=SPACED):
    w = words.findall(ascii_lower(text or ""))
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def near_copies(seed):
    """Groups whose members differ in some words, so that some pairs link, some only through others."""
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        base = sentence(rng, rng.randrange(30, 120)).split()
        for _ in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = rng.choice("xyz") * rng.randrange(1, 4)
            if rng.random() < 0.3:
                own = own[: -rng.randrange(1, 8)]
            texts.append(" ".join(own))
    texts += ["", None, "one two", "one  TWO", "one two three"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def components_by_force(rows):
    sets = {i: set(word_shingles(t)) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()}
    assert found == components_by_force(rows)


def test_one_of_each_keeps_the_smallest(spark, odd, no_docs):
    rows = [*near_copies(3), (500, "again and again and again"), (500, "again and again and again")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, lang string")
    kept = sorted(r.doc_id for r in jaccard_join.one_of_each(df).collect())
    assert kept == sorted({i for i, (_, c) in components_by_force(dict(rows).items()).items() if c == i})
    result = jaccard_join.jaccard_components(odd).collect()
    assert len(result) == odd.count()
    assert {r.component_id for r in result if r.doc_id in (5, 6)} == {5}
    assert [(r.n_shingles, r.component_id) for r in result if r.doc_id == 3] == [(0, 3)]
    left = jaccard_join.one_of_each(odd)
    assert left.columns == odd.columns
    assert Counter(r.doc_id for r in left.collect()) == {1: 2, 2: 1, 3: 1, 4: 1, 5: 1, 7: 1, 8: 1, None: 2, 9: 1, 10: 1}
    assert jaccard_join.jaccard_components(no_docs).count() == 0 and jaccard_join.one_of_each(no_docs).count() == 0


def test_prefixes_of_linked_sets_meet_in_every_order():
    rng = np.random.default_rng(1)
    levels = rng.integers(0, 3, jaccard_join.COUNTERS).astype(np.uint8)
    for _ in range(200):
        pool = rng.integers(0, 1 << 62, 60).astype(np.uint64)
        x, y = (np.unique(rng.choice(pool, rng.integers(40, 60), replace=False)) for _ in range(2))
        if jaccard_join.links(x, y):
            for seed in jaccard_join.ORDERS:
                assert len(np.intersect1d(jaccard_join.prefix(x, levels, seed), jaccard_join.prefix(y, levels, seed)))


def test_shingles_equal_plain_python():
    rng = random.Random(2)
    texts = ["", " ", "A b\tc", "Über ß x y z a b", *["".join(rng.choice(["ab", "cd", "Ab", "é", " ", "\n", "x"]) for _ in range(rng.randrange(40))) for _ in range(200)]]
    found = shingles.sets(pa.array(["skipped", *texts])[1:])
    plain = [set(word_shingles(t)) for t in texts]
    assert [len(s) for s in found] == [len(s) for s in plain]
    for i, j in combinations(range(0, 200, 5), 2):
        assert len(np.intersect1d(found[i], found[j])) == len(plain[i] & plain[j])


def leaks_by_force(docs, items):
    out = {}
    for doc, text in docs:
        own = word_shingles(text, ALNUM)
        for item, item_text in items:
            wanted = word_shingles(item_text, ALNUM)
            for start in range(max(1, len(own) - len(wanted) + 1)) if wanted else ():
                a, b = Counter(own[start : start + len(wanted)]), Counter(wanted)
                alike = sum((a & b).values()) / max(1, sum((a | b).values()))
                if alike >= 0.8 and alike > out.get((doc, item), (0, 0))[0]:
                    out[doc, item] = alike, start
    return out


def test_leaks_equal_brute_force(spark, odd, no_docs):
    rng = random.Random(6)
    items = [(i, sentence(rng, rng.randrange(3, 60))) for i in range(25)] + [(90, None), (91, ""), (92, "one"), (93, items_twice := sentence(rng, 20)), (94, items_twice)]
    docs = []
    for i in range(60):
        words = sentence(rng, rng.randrange(0, 150)).split()
        if i % 2:
            passage = (rng.choice(items)[1] or "").split()
            if i % 4 == 1 and len(passage) > 45:
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() + "," for w in passage]
        docs.append((i, " ".join(words)))
    docs += [(100, None), (101, "one"), (102, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in decontamination.leaks(df, benchmark).collect()}
    wanted = leaks_by_force(docs, items)
    assert {k: (round(a, 9), b) for k, (a, b) in found.items()} == {k: (round(a, 9), b) for k, (a, b) in wanted.items()}
    kept = {r.doc_id for r in decontamination.clean(df, benchmark).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in wanted}
    assert decontamination.clean(odd, benchmark).count() == odd.where("text IS NULL OR text <> 'one'").count()
    assert decontamination.leaks(no_docs, benchmark).count() == 0
    assert decontamination.leaks(df, benchmark.limit(0)).count() == 0


def test_blocks_find_all_fingerprints_within_the_radius():
    rng = np.random.default_rng(3)
    own = [rng.integers(0, 1 << 62, 30).astype(np.uint64) for _ in range(20)]
    items = decontamination.Items.of(list(range(20)), own)
    windows = items.fingerprints[rng.integers(0, 20, 300)]
    for _ in range(20):
        windows = windows ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    near = {(w, i): d for w, i, d in items.near(windows)}
    distance = np.bitwise_count(windows[:, None] ^ items.fingerprints[None, :])
    assert near == {(w, i): int(distance[w, i]) for w, i in zip(*np.nonzero(distance <= decontamination.RADIUS), strict=True)}


def test_near_copies_at_the_threshold_are_found():
    """Copies with a similarity from 0.8 to 0.85: the pairs whose fingerprints are
    too far apart to be compared."""
    rng = np.random.default_rng(9)
    pairs = missed = 0
    while pairs < 20_000:
        n = int(rng.integers(20, 61))
        item = rng.integers(0, 1 << 63, n).astype(np.uint64)
        changed = int(rng.integers(1, n // 9 + 2))
        alike = (n - changed) / (n + changed)
        if not 0.8 <= alike <= 0.85:
            continue
        copy = np.concatenate([item[changed:], rng.integers(0, 1 << 63, changed).astype(np.uint64)])
        pairs += 1
        items = decontamination.Items.of([0], [item])
        window = decontamination.Items.of([0], [copy]).fingerprints
        missed += not any(True for _ in items.near(window))
    assert missed <= pairs * 0.0005


def test_leaks_find_one_changed_word_in_long_items(spark):
    rng = random.Random(10)
    items = [(i, " ".join(f"w{rng.randrange(1 << 40)}" for _ in range(49))) for i in range(2000)]
    docs = []
    for i, text in items:
        words = text.split()
        words[rng.randrange(4, 45)] = "changed"
        docs.append((i, " ".join(words)))
    df, benchmark = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    found = decontamination.leaks(df, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i, _ in items}
    assert {r.similarity for r in found} == {0.8}


def test_licences_equal_sql_and_odd_texts(spark, odd, no_docs):
    rng = random.Random(8)
    lines = [t for _, t in licenses.TEMPLATES] + ["mit license", "The MIT\tLicense", "mit  license mit license", "Apache-License", "transmit license", "general public license", "LICENSED under CC BY-NC 4.0 by them all", "mit", "Kit license", "released under mit"]
    docs = [(i, "\n".join(rng.choice([*lines, sentence(rng, 8)]) for _ in range(rng.randrange(6)))) for i in range(80)] + [(200, None), (201, ""), (202, "license"), (203, "mit")]
    documents = pa.table({"doc_id": [i for i, _ in docs], "text": [t for _, t in docs]})
    con = duckdb.connect()
    con.register("documents", documents)
    sql = con.execute(licenses.oracle())
    names = [c[0] for c in sql.description]
    wanted = sorted(map(tuple, sql.fetchall()))
    found = licenses.scan(spark.createDataFrame(docs, "doc_id bigint, text string")).select(*names)
    assert sorted(map(tuple, found.collect())) == wanted
    assert licenses.scan(odd).count() == odd.count()
    assert licenses.scan(no_docs).count() == 0


def test_licences_of_wrapped_notices_and_scattered_words(spark):
    rng = random.Random(11)
    text = {label: t for label, t in licenses.TEMPLATES}
    filler = lambda n: " ".join(rng.choice(["stone", "river", "the", "is", "of", "and"]) for _ in range(n))
    wrapped = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that"
    docs = [
        (0, wrapped, "bsd"),
        (1, filler(20_000) + "\n" + wrapped + "\n" + filler(300), "bsd"),
        (2, filler(30) + "\n" + text["mpl"].replace(" ", "\n") + " " + filler(30), "mpl"),
        (3, text["cc-by-nc"].replace("CC", "\n * CC"), "cc-by-nc"),
        (4, "released " + filler(50) + " under " + filler(50) + " the " + filler(50) + " mit " + filler(50) + " license", ""),
        (5, text["bsd"].replace(" in ", " " + filler(licenses.SLACK + 20) + " in "), ""),
        (6, text["bsd"].replace(" in ", " a b c d in "), "bsd"),
        (7, filler(5000) + " " + text["cc-by-sa"], "cc-by-sa"),
        (8, None, ""),
    ]
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id bigint, text string")
    assert {r.doc_id: r.labels for r in licenses.scan(df).collect()} == {i: labels for i, _, labels in docs}


def test_a_notice_of_one_licence_is_none_of_a_longer_name(spark):
    text = dict(licenses.TEMPLATES)
    df = spark.createDataFrame([(1, text["gpl"]), (2, text["lgpl"]), (3, text["gpl"].replace(" ", "\n")), (4, text["lgpl"].replace("Lesser", "lesser"))], "doc_id bigint, text string")
    assert {r.doc_id: r.labels for r in licenses.scan(df).collect()} == {1: "gpl", 2: "gpl,lgpl", 3: "gpl", 4: "gpl,lgpl"}


def blocks_by_force(text):
    words, found = ALNUM.findall(ascii_lower(text)), {}
    for number, (label, template) in enumerate(licenses.TEMPLATES):
        own = ALNUM.findall(ascii_lower(template))
        width = len(own) + licenses.SLACK
        blocks = [set(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
        shared = max(len(b & set(own)) if label != "lgpl" or "lesser" in b else 0 for b in blocks)
        if shared >= licenses.needed(len(set(own)), licenses.THRESHOLD):
            found[number] = shared / len(set(own))
    return found


def test_blocks_equal_brute_force(spark):
    rng = random.Random(12)
    docs = []
    for i in range(150):
        words = []
        for _ in range(rng.randrange(1, 4)):
            own = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randrange(9)):
                own.insert(rng.randrange(len(own) + 1), rng.choice(["x", "the", "\n", "license", "\n#"]))
            if rng.random() < 0.4:
                del own[rng.randrange(len(own))]
            words += own + ["y"] * rng.randrange(12)
        docs.append((i, " ".join(words)))
    found = {i: {} for i, _ in docs}
    for r in licenses.containment_join(spark.createDataFrame(docs, "doc_id bigint, text string")).collect():
        found[r.doc_id][r.template] = r.containment
    assert found == {i: blocks_by_force(t) for i, t in docs}


def nearest_by_force(rows, every, k):
    out = {}
    for i, v in rows:
        if i % every == 0:
            scores = sorted((-float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), j) for j, w in rows if j != i)
            out[i] = [(j, round(-s, 9)) for s, j in scores[:k]]
    return out


def test_neighbours_equal_brute_force_where_all_is_searched(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16)) for i in range(300)]
    rows += [(1000 + i, rows[10][1]) for i in range(40)]  # many rows with one vector
    bad = [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [None] * 16), (None, [1.0] * 16), (405, [float("inf")] * 16), (405, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows] + [(rows[0][0], rows[0][1].tolist())] + bad, "vec_id bigint, embedding array<double>")
    found = {}
    for r in hilbert_neighbours.neighbours(df.withColumn("rank", F.lit(1)), every=10).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    assert found == nearest_by_force(rows, 10, 5)
    assert hilbert_neighbours.neighbours(df.limit(0), every=10).count() == 0


def test_recall_of_windows(spark, monkeypatch):
    """Chunks small enough that most of the index is outside the windows; vectors without structure."""
    monkeypatch.setattr(hilbert_neighbours, "CHUNK", 64)
    monkeypatch.setattr(hilbert_neighbours, "TOGETHER", 4)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=64)) for i in range(3000)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id bigint, embedding array<double>")
    wanted = nearest_by_force(rows, 50, 5)
    found = {}
    for r in hilbert_neighbours.neighbours(df, every=50).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len({j for j, _ in wanted[q]} & found[q]) for q in wanted)
    assert hits / (5 * len(wanted)) >= 0.9


def test_hilbert_neighbours_on_the_curve_are_neighbours_in_the_grid():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = np.argsort(hilbert_neighbours.hilbert_keys(grid, 3))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def test_bound_by_a_pivot_is_never_too_low():
    rng = np.random.default_rng(5)
    for _ in range(300):
        pool = rng.integers(0, 1 << 62, 300).astype(np.uint64)
        x, y, p = (np.unique(rng.choice(pool, rng.integers(1, 200))) for _ in range(3))
        a, b = (jaccard_join.against(s, p) for s in (x, y))

        def both(bits, again):
            return int(np.bitwise_count((a[bits] & b[bits]).view(np.uint64)).sum()) + min(a[again], b[again])

        assert len(np.intersect1d(x, y)) <= a["shared"] - b["lacks"] + both("less", "less_again") + both("more", "more_again")
        assert a["shared"] == len(np.intersect1d(x, p)) and a["lacks"] == len(p) - a["shared"]


def test_many_copies_around_the_threshold_equal_brute_force(spark, monkeypatch):
    """Copies of one text with some words replaced: links, near misses, and edits that some share."""
    monkeypatch.setattr(jaccard_join, "PIVOT_LIST", 3)
    rng = random.Random(21)
    base = [f"w{i}" for i in range(120)]
    docs = [(0, " ".join(base))]
    for i in range(1, 120):
        words = list(base)
        for k in range(rng.choice([1, 2, 3, 4])):
            words[rng.randrange(120)] = rng.choice([f"x{i}-{k}", "shared", "also"])
        if rng.random() < 0.3:
            words = words[: rng.randrange(80, 120)]
        docs.append((i, " ".join(words)))
    rows = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    own = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in docs}
    label = {i: i for i in own}
    changed = True
    while changed:
        changed = False
        for i in own:
            for j in own:
                if label[j] < label[i] and 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j]):
                    label[i], changed = label[j], True
    assert rows == label and len(set(label.values())) > 5


def test_rows_of_lists_are_kept_where_the_bounds_leave_a_pair():
    rng = np.random.default_rng(17)
    for case in range(40):
        sizes = rng.integers(1, 60, rng.integers(1, 30))
        token = np.repeat(np.sort(rng.choice(1 << 40, len(sizes), replace=False)) - (1 << 39), sizes)
        n = rng.integers(90, 110, len(token)) if case % 2 else rng.integers(5, 400, len(token))
        at = rng.integers(0, 1 + n // 5)
        kept, crowded = jaccard_join.partnered(token, n, at)
        for one in np.unique(token):
            rows = np.flatnonzero(token == one).tolist()
            pairs = [(x, y) for x, y in combinations(rows, 2) if 100 * min(n[x], n[y]) >= 80 * max(n[x], n[y]) and min(n[x] - at[x], n[y] - at[y]) * 180 >= 80 * (n[x] + n[y])]
            wanted = {row for pair in pairs for row in pair}
            assert {row for row in rows if kept[row]} == wanted
            assert {bool(crowded[row]) for row in rows} == {len(pairs) > jaccard_join.CROWDED * len(wanted)}
        kept, crowded = jaccard_join.partnered(token, n, at, through=int(token[0]))
        assert kept[token == token[0]].all() and crowded[token == token[0]].all()


def test_long_lists_keep_all_rows_over_batches():
    rows = jaccard_join.LIST_ROWS + 5000
    token = np.concatenate([np.full(3, -7), np.zeros(rows, np.int64), np.full(2, 9)])
    n = np.concatenate([[10, 100, 101], 100 + np.arange(rows) % 1000, [50, 50]])
    table = pa.table({"token": token, "node": np.arange(len(token)), "n": n.astype(np.int32), "at": np.zeros(len(token), np.int32)})
    found = pa.Table.from_batches(jaccard_join._partnered(table.to_batches(500)))
    assert found.column("node").to_pylist() == list(range(1, len(token)))
    assert found.column("crowded").to_pylist() == [False] * 2 + [True] * rows + [False] * 2


def test_texts_of_many_lengths_with_a_passage_are_not_fetched(spark, monkeypatch):
    """Counters that tell nothing stand for a corpus with many shingles a counter."""
    rng = random.Random(33)
    passage, docs = [f"p{i}" for i in range(60)], []
    for i in range(40):
        own = [f"w{i}-{k}" for k in range(int(60 * 1.08**i))]
        at = rng.randrange(len(own))
        docs.append(own[:at] + passage + own[at:])
    docs += [[*d[:-1], "changed"] for d in docs[::8]]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    tables, store = {}, jaccard_join.stored

    def recorded(df, path):
        return tables.setdefault(path, store(df, path))

    monkeypatch.setattr(jaccard_join, "stored", recorded)
    monkeypatch.setattr(jaccard_join, "_levels", lambda blocks, folder: np.zeros(jaccard_join.COUNTERS, np.uint8))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()}
    assert found == components_by_force(rows)
    assert [t.count() for path, t in tables.items() if path.endswith("/asked")] == [0]
