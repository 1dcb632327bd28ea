"""Current flags, validity intervals and questions about a point in time.

The end of a version is the next strictly later load date of its key. One
window over the key would put a hot key's whole history into a single task, so
no window follows a key: distinct (key, time) pairs are range-partitioned, a hot
key like any other over as many partitions as it fills, and chained inside each
partition as they stream by in order. The chained pairs are stored: sorted as they
are they take a fraction of what one more shuffle of them would. Only the first and
the last pair of every partition are chained across partitions. Rows sharing a time
never meet in one task because the pairs are distinct. The result goes back to the
rows by an equi-join on (key, time), whose row side AQE may split.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from annalake.operators.matching import present_in
from annalake.sources import sinks
from annalake.specs import END_DATE, IS_ACTIVE, IS_CURRENT, LOAD_DATE, START_DATE

# The helpers travel with the task, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def in_parts(points: DataFrame, key: str, ts: str) -> DataFrame:
    """Distinct pairs with ``_part``, the number of their range partition."""
    return points.repartitionByRange(key, ts).withColumn("_part", F.spark_partition_id())


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted distinct pairs of one partition with their key's next time. ``_end`` adds
    1 for the partition's first pair and 2 for its last, whose next time isn't known."""
    held, first = None, 1

    def linked(here: pa.Table, following: pa.ChunkedArray, last: int) -> Iterator[pa.RecordBatch]:
        nonlocal first
        ends = pa.array([first | last, *[0] * (here.num_rows - 1)], pa.int32())
        first = 0
        yield from here.append_column("_next", following).append_column("_end", ends).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        n = rows.num_rows - 1
        here, then, held = rows.slice(0, n), rows.slice(1), rows.slice(n)
        if n:
            same = pc.equal(here["_key"], then["_key"])
            yield from linked(here, pc.if_else(same, then["_ts"], pa.scalar(None, then["_ts"].type)), 0)
    if held is not None:
        yield from linked(held, pa.nulls(1, held["_ts"].type), 2)


def next_later(df: DataFrame, key: str, ts: str) -> DataFrame:
    """One row per distinct (key, ts) with ``next_ts``, the key's next later time.

    Rows without key or time belong to no timeline and are left out; joined
    back, they stay open. The chained pairs are on shared storage, so what is
    returned may be read more than once.
    """
    given = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    placed = in_parts(given.select(F.col(key).alias("_key"), F.col(ts).alias("_ts")).distinct(), "_key", "_ts")
    pairs = placed.drop("_part").sortWithinPartitions("_key", "_ts")
    fields = [T.StructField(f.name, f.dataType) for f in pairs.schema.fields]
    schema = T.StructType([*fields, T.StructField("_next", fields[1].dataType), T.StructField("_end", T.IntegerType())])
    chained = sinks.write_once(pairs.mapInArrow(_chained, schema))
    # The ends of all partitions, at most two rows each, are chained in a group of
    # their own. Range-partitioned again they might fall at other bounds, but they are stored.
    follower = F.lead(F.struct("_key", "_ts")).over(Window.partitionBy("_all").orderBy("_key", "_ts"))
    ends = chained.where("_end > 0").withColumn("_all", F.lit(0)).withColumn("_follower", follower).where("_end >= 2")
    same = F.when(F.col("_follower")["_key"] == F.col("_key"), F.col("_follower")["_ts"])
    after = chained.where("_end < 2").select("_key", "_ts", "_next").unionByName(ends.select("_key", "_ts", same.alias("_next")))
    return after.select(F.col("_key").alias(key), F.col("_ts").alias(ts), F.col("_next").alias("next_ts"))


def newest(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """All rows at their key's latest time, and those without key or time."""
    latest = rows.groupBy(key).agg(F.max(ts).alias(ts)).where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    return present_in(rows, latest, [key, ts]).unionByName(rows.where(F.col(key).isNull() | F.col(ts).isNull()))


def _close(df: DataFrame, key: str, ts: str, flag: str, end: str) -> DataFrame:
    order = [c for c in df.columns if c not in (flag, end)]
    rows = df.select(*[f"`{c}`" for c in order])
    later = next_later(rows, key, ts).withColumnsRenamed({key: "_key", ts: "_ts"})
    joined = rows.join(later, (rows[key] == F.col("_key")) & (rows[ts] == F.col("_ts")), "left")
    return joined.select(
        *[rows[f"`{c}`"] for c in order],
        F.when(F.col("next_ts").isNull(), F.lit("Y")).otherwise(F.lit("N")).alias(flag),
        F.col("next_ts").alias(end),
    )


def close_versions(sat: DataFrame, hk: str, ts: str = LOAD_DATE) -> DataFrame:
    """Recompute ``dss_is_current`` / ``dss_end_date`` from the load dates.

    All rows tied at the key's last load date stay current.
    """
    return _close(sat, hk, ts, IS_CURRENT, END_DATE)


def close_relationships(eff: DataFrame, driving_hk: str, ts: str = START_DATE) -> DataFrame:
    """The same on an effectivity satellite, along its driving key."""
    return _close(eff, driving_hk, ts, IS_ACTIVE, END_DATE)


def close_open_only(
    table: DataFrame,
    key: str,
    ts: str = LOAD_DATE,
    flag: str = IS_CURRENT,
    end: str = END_DATE,
    later: DataFrame | None = None,
) -> DataFrame:
    """Close only rows still flagged 'Y'; rows closed earlier keep their end date.

    This is what an in-place UPDATE after each load does. A late-arriving row is
    closed at the next later load date, but the version it splits keeps its old
    end, so intervals may overlap; ``close_versions`` repairs that. ``later`` is what
    ``next_later`` found for the same keys and times, if that is known.
    """
    order = table.columns
    later = (next_later(table, key, ts) if later is None else later).withColumnsRenamed({key: "_key", ts: "_ts"})
    joined = table.join(later, (table[key] == F.col("_key")) & (table[ts] == F.col("_ts")), "left")
    closing = (F.col(flag) == "Y") & F.col("next_ts").isNotNull()
    return joined.select(
        *[table[f"`{c}`"] for c in order if c not in (flag, end)],
        F.when(closing, F.lit("N")).otherwise(F.col(flag)).alias(flag),
        F.when(closing, F.col("next_ts")).otherwise(F.col(end)).alias(end),
    ).select(*[f"`{c}`" for c in order])


def current(sat: DataFrame, flag: str = IS_CURRENT) -> DataFrame:
    return sat.where(F.col(flag) == "Y")


def history(sat: DataFrame, hk: str, key: str, ts: str = LOAD_DATE) -> DataFrame:
    """All versions of one key, newest first."""
    return sat.where(F.col(hk) == key).orderBy(F.col(ts).desc())


def as_of(sat: DataFrame, moment: str, start: str = LOAD_DATE, end: str = END_DATE) -> DataFrame:
    """Versions valid at a moment, intervals half open."""
    at = F.lit(moment).cast("timestamp_ntz")
    return sat.where((F.col(start) <= at) & ((F.col(end) > at) | F.col(end).isNull()))


def relationship_as_of(eff: DataFrame, moment: str) -> DataFrame:
    """Relationships in force at a moment."""
    return as_of(eff, moment, START_DATE, END_DATE)


def interval_overlaps(
    sat: DataFrame, hk: str, ts: str = LOAD_DATE, end: str = END_DATE, later: DataFrame | None = None
) -> DataFrame:
    """Versions whose interval reaches past the start of the key's next version.
    ``later`` is what ``next_later`` found for the same keys and times, if that is known."""
    later = (next_later(sat, hk, ts) if later is None else later).withColumnsRenamed({hk: "_key", ts: "_ts"})
    joined = sat.join(later, (sat[hk] == F.col("_key")) & (sat[ts] == F.col("_ts")), "left")
    reaches = F.col("next_ts").isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col("next_ts")))
    return joined.where(reaches).select(*[sat[f"`{c}`"] for c in sat.columns], F.col("next_ts").alias("next_load_date"))
