"""Boundary sets against sorted lists, and cuts against a plain version."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from annalake.llm import fill_in_middle as fim

SHAPES = {
    fim.ArrayContainer: [3, 9, 70, 4000, 65535],
    fim.BitmapContainer: sorted(random.Random(1).sample(range(1 << 16), 20_000)),
    fim.RunContainer: [*range(100, 9000), *range(20_000, 30_000)],
}


@pytest.mark.parametrize("kind", SHAPES)
def test_containers_are_the_smallest_and_select_every_value(kind):
    values = np.array(SHAPES[kind], np.uint16)
    container = fim.container_of(values)
    assert type(container) is kind
    assert [container.select(k) for k in range(len(values))] == values.tolist()


def test_sets_over_several_containers():
    offsets = np.array(sorted({o + (key << 16) for key, shape in zip((0, 1, 5), SHAPES.values()) for o in shape}))
    bounds = fim.BoundarySet.of(offsets)
    assert len(bounds) == len(offsets) and {type(c) for c in bounds.containers} == set(SHAPES)
    assert [bounds.select(k) for k in range(len(offsets))] == offsets.tolist()
    assert len(fim.BoundarySet.of(np.zeros(0, np.int64))) == 0


def plain(doc_id, text, rate=100, spm_rate=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not text or re.search("<P>|<S>|<M>", text) or h3 % 100 >= rate:
        return n, "plain", text, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < spm_rate:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), st.text(alphabet="ab\n\r<PSM>é😀\x85", max_size=40))
def test_cuts_equal_a_plain_version(doc_id, text):
    cut = fim.transform(text, fim.draws(7, doc_id))
    assert (cut.n, cut.form, cut.output, cut.prefix, cut.middle) == plain(doc_id, text)
    assert fim.restore(cut.output, cut.form) == text


@pytest.mark.parametrize("text", ["\n" * 70_000, "x\n" * 50_000, "x" * 200_000, "a\nb" * 90_000])
def test_long_texts_in_every_container(text):
    for doc_id in range(6):
        cut = fim.transform(text, fim.draws(7, doc_id), spm_rate=100 * (doc_id % 2))
        assert (cut.n, cut.form, cut.output, cut.prefix, cut.middle) == plain(doc_id, text, spm_rate=100 * (doc_id % 2))


def test_odd_texts_in_spark(odd, no_docs):
    rows = fim.fill_in_middle(odd, rate=80, spm_rate=60).collect()
    expected = [(r.doc_id, *plain(r.doc_id, r.text or "", 80, 60), r.text or "") for r in odd.collect()]
    found = [(r.doc_id, r.n, r.form, r.output, r.prefix_chars, r.middle_chars, r.restored) for r in rows]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    hashed = fim.fill_in_middle(odd, rate=80, spm_rate=60, digests=True).collect()
    assert sorted((r.output_sha256, r.restored_sha256) for r in hashed) == sorted(
        (hashlib.sha256(r.output.encode()).hexdigest(), hashlib.sha256(r.restored.encode()).hexdigest()) for r in rows
    )
    assert fim.fill_in_middle(no_docs).collect() == []
