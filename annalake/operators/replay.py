"""The outcome of N ordered incremental loads, computed in one pass.

Instead of looping over batches, each rule is stated in closed form: a key is
inserted by the first batch that carries it. First batches are plain
aggregations (combined map-side, indifferent to hot keys) joined back to the
rows. Where a load compares with what the load before left, each batch is reduced
to its different values and a key's batches are followed in order; no window or
list ever spans a key's rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalake.operators.history import newest
from annalake.operators.loads import open_version
from annalake.operators.matching import absent_from, present_in
from annalake.sources.sinks import write_once
from annalake.specs import END_DATE, IS_ACTIVE, LOAD_DATE, RECORD_SOURCE, START_DATE

# The helpers travel with the task, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Different (batch, value) pairs of a key that one task follows.
BUSY = 1 << 18


def _first_seen(feed: DataFrame, columns: list[str], key: str, batch: str) -> DataFrame:
    """Distinct rows whose batch is the first one carrying their key. Rows are shuffled
    once, for the join: what is left of them is folded where it lies."""
    given = feed.where(F.col(key).isNotNull())
    first = given.groupBy(key).agg(F.min(batch).alias("_batch"))
    rows = given.select(*columns, F.col(batch).alias("_batch"))
    return present_in(rows, first, [key, "_batch"], distinct=True).select(*columns)


def replay_hub(feed: DataFrame, batch: str, hk: str, business_keys: Sequence[str]) -> DataFrame:
    return _first_seen(feed, [hk, *business_keys, LOAD_DATE, RECORD_SOURCE], hk, batch)


def replay_link(
    feed: DataFrame,
    batch: str,
    link_hk: str,
    hub_hks: Sequence[str],
    extra: Sequence[str] = (),
    not_null: Sequence[str] = (),
) -> DataFrame:
    given = feed
    for column in not_null:
        given = given.where(F.col(column).isNotNull())
    return _first_seen(given, [link_hk, *hub_hks, *extra, LOAD_DATE, RECORD_SOURCE], link_hk, batch)


def _follow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that loads add, of rows sorted by key, batch and time, latest first.

    What is held is the state of one key: its newest time, the values it has there,
    and those that the current batch adds at the batch's newest time.
    """
    key = batch = newest = top = None
    known: set = set()
    added: set = set()
    for rows in batches:
        times = rows.column("_last")
        times = times.cast(pa.int64() if times.type.bit_width == 64 else pa.int32()).to_pylist()
        keep = []
        for k, b, value, at in zip(rows.column("_key").to_pylist(), rows.column("_batch").to_pylist(), rows.column("_value").to_pylist(), times, strict=True):
            if k != key or b != batch:
                if top is not None and (newest is None or top >= newest):
                    known = known | added if top == newest else added
                    newest = top
                if k != key:
                    known, newest = set(), None
                key, batch, top, added = k, b, None, set()
            new = value not in known
            keep.append(new)
            if new and at is not None and (top is None or at == top):
                top = at
                added.add(value)
        yield rows.select(["_key", "_batch", "_value"]).filter(pa.array(keep, pa.bool_()))


def _follow_batches(last: DataFrame) -> DataFrame:
    """The same, one batch after the other, each a join with the state that the
    batches before left: for keys too large for one task."""
    state, parts = None, []
    for (batch,) in sorted(last.select("_batch").distinct().collect()):
        rows = last.where(F.col("_batch") == F.lit(batch))
        new = write_once(rows if state is None else absent_from(rows, state, ["_key", "_value"]))
        parts.append(new.select("_key", "_batch", "_value"))
        dated = new.select("_key", "_value", "_last").where("_last IS NOT NULL")
        state = write_once(newest(dated if state is None else dated.unionByName(state), "_key", "_last"))
    return reduce(DataFrame.unionByName, parts)


def _changes(feed: DataFrame, batch: str, key: str, value: str, busy: int = BUSY) -> DataFrame:
    """Rows whose value the key doesn't have at its newest load date when their batch is loaded.

    A load adds the rows whose value isn't among those the key has at its newest
    load date; the newest of the added rows then are the key's newest, unless older
    loads have later ones. All that this needs of a batch is the last load date of
    each value. These rows are followed key by key, in a stream that costs the same
    for every row, whatever number of batches a key has. Keys with more than ``busy``
    of them go batch by batch instead, each step a distributed join.
    """
    given = feed.where(F.col(key).isNotNull())
    names = [F.col(c).alias(n) for c, n in ((key, "_key"), (batch, "_batch"), (value, "_value"))]
    last = write_once(given.groupBy(*names).agg(F.max(LOAD_DATE).alias("_last")))
    heavy = last.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > busy).select("_key")
    # Stored rows are counted without reading them.
    some = last.count() > busy and not heavy.isEmpty()
    calm = absent_from(last, heavy, ["_key"]) if some else last
    order = ["_key", "_batch", F.col("_last").desc()]
    added = calm.repartition("_key").sortWithinPartitions(*order).mapInArrow(_follow, last.drop("_last").schema)
    if some:
        added = added.unionByName(_follow_batches(write_once(present_in(last, heavy, ["_key"]))))
    return present_in(given, added.toDF(key, batch, value), [key, batch, value])


def replay_satellite(
    feed: DataFrame,
    batch: str,
    hk: str,
    hd: str,
    payload: Sequence[str],
    compare: str = "any",
    busy: int = BUSY,
) -> DataFrame:
    """Satellite after all loads, open; pass the result to ``close_versions``.

    ``compare="any"`` keeps every row of the batch that first has its diff;
    ``"latest"`` every row whose diff isn't among the key's newest ones.
    """
    if compare == "any":
        first = feed.groupBy(hk, hd).agg(F.min(batch).alias(batch))
        rows = feed.join(first, [hk, hd, batch], "left_semi")
    elif compare == "latest":
        rows = _changes(feed, batch, hk, hd, busy)
    else:
        raise ValueError("compare must be 'any' or 'latest'")
    return open_version(rows.select(hk, hd, LOAD_DATE, RECORD_SOURCE, *[f"`{c}`" for c in payload]))


def replay_eff_satellite(
    feed: DataFrame,
    batch: str,
    link_hk: str,
    driving_hk: str,
    hub_hks: Sequence[str],
    busy: int = BUSY,
) -> DataFrame:
    """Effectivity satellite after all loads, open: every relationship that
    wasn't active when its batch was loaded. After each load those at the
    driving key's latest start date are active."""
    given = feed
    for column in (link_hk, *hub_hks):
        given = given.where(F.col(column).isNotNull())
    # Equal rows are one in a batch; another batch may bring them again.
    rows = _changes(given, batch, driving_hk, link_hk, busy).select(batch, link_hk, *hub_hks, LOAD_DATE, RECORD_SOURCE).distinct()
    return rows.select(
        link_hk,
        *hub_hks,
        F.col(LOAD_DATE).alias(START_DATE),
        F.lit(None).cast("timestamp_ntz").alias(END_DATE),
        F.lit("Y").alias(IS_ACTIVE),
        RECORD_SOURCE,
    )
