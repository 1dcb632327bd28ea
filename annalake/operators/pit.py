"""Point-in-time tables and bridges.

A point-in-time table asks, for every key and snapshot day, which satellite
version was the last one loaded by the end of that day. Nothing is crossed or
range-joined: versions are reduced to one row per key and day, the snapshots
are numbered in order, each row then covers the snapshots up to the key's next
row, and that run is expanded. The work is linear in the table produced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalake.operators.matching import with_partners
from annalake.sources import sinks
from annalake.specs import LOAD_DATE, RECORD_SOURCE

# Metadata of the rebuilt table.
PIT_SOURCE = "PIT_GENERATION"

# Days one row expands to within a task.
BLOCK_DAYS = 64


def snapshot_spine(satellites: Sequence[DataFrame], ts: str = LOAD_DATE) -> DataFrame:
    """Distinct load days over one or many satellites."""
    days = [sat.select(F.to_date(ts).alias("snapshot_date")) for sat in satellites]
    return reduce(DataFrame.union, days).where(F.col("snapshot_date").isNotNull()).distinct()


def _numbered(version_days: DataFrame, spine: DataFrame | None) -> DataFrame:
    """Days as (day, is_snapshot, first, snapshots): the number of the first
    snapshot on or after the day, and how many snapshots there are.

    At most one row per calendar day, about 37,000 per century: small enough
    for the ordering window and for broadcasting, by construction.
    """
    days = version_days.select("day", F.lit(1 if spine is None else 0).alias("is_snapshot")).distinct()
    if spine is not None:
        asked = spine.select(F.to_date("snapshot_date").alias("day"), F.lit(1).alias("is_snapshot"))
        days = days.union(asked).groupBy("day").agg(F.max("is_snapshot").alias("is_snapshot"))
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return days.select(
        "day",
        "is_snapshot",
        (F.sum("is_snapshot").over(so_far) + 1 - F.col("is_snapshot")).alias("first"),
        F.sum("is_snapshot").over(everything).alias("snapshots"),
    )


def _expand(runs: DataFrame, hk: str) -> DataFrame:
    """One row per day number from ``first`` to ``last``.

    A run may cover thousands of days, and adaptive execution sizes tasks by the
    short runs it reads, not by what they expand to. Runs are therefore cut into
    blocks of days first and the blocks spread out; a row then yields at most
    ``BLOCK_DAYS`` rows in its task.
    """
    first_block, last_block = (F.floor(F.col(c) / BLOCK_DAYS) for c in ("first", "last"))
    return (
        runs.withColumn("_block", F.explode(F.sequence(first_block, last_block)))
        .withColumn("first", F.greatest(F.col("first"), F.col("_block") * BLOCK_DAYS))
        .withColumn("last", F.least(F.col("last"), F.col("_block") * BLOCK_DAYS + BLOCK_DAYS - 1))
        .repartition(hk, "_block")
        .withColumn("number", F.explode(F.sequence("first", "last")))
        .drop("first", "last", "_block")
    )


def _pointers(
    hub: DataFrame, satellites: Mapping[str, DataFrame], hk: str, spine: DataFrame | None, ts: str
) -> DataFrame:
    """(hk, snapshot_date, <sat> load date...) for every day some satellite covers."""
    names = list(satellites)
    versions = reduce(
        DataFrame.unionByName,
        [
            sat.where(F.col(ts).isNotNull()).select(
                hk,
                F.to_date(ts).alias("day"),
                *[(F.col(ts) if n == name else F.lit(None).cast("timestamp_ntz")).alias(n) for n in names],
            )
            for name, sat in satellites.items()
        ],
    )
    daily = versions.groupBy(hk, "day").agg(*[F.max(n).alias(n) for n in names])
    days = _numbered(versions, spine)
    # From here on a key has at most one row per day, whatever it had before.
    by_key = Window.partitionBy(hk).orderBy("day")
    runs = (
        daily.join(F.broadcast(days.select("day", "first", "snapshots")), "day")
        .select(
            hk,
            "first",
            (F.coalesce(F.lead("first").over(by_key), F.col("snapshots") + 1) - 1).alias("last"),
            *[F.last(n, ignorenulls=True).over(by_key).alias(n) for n in names],
        )
        .where(F.col("first") <= F.col("last"))
        .join(hub.select(hk).distinct(), hk, "left_semi")
    )
    expanded = _expand(runs, hk)
    snapshots = days.where("is_snapshot = 1").select(F.col("first").alias("number"), F.col("day").alias("snapshot_date"))
    return expanded.join(F.broadcast(snapshots), "number").select(hk, "snapshot_date", *names)


def pit(
    hub: DataFrame,
    sat: DataFrame,
    hk: str,
    name: str,
    now: str,
    spine: DataFrame | None = None,
    ts: str = LOAD_DATE,
) -> DataFrame:
    """Point-in-time table over one satellite; days before a key's first version
    have no row. Days compare inclusively, so a version loaded at 14:30 counts
    for its own day. ``spine`` replaces the satellite's own load days."""
    found = _pointers(hub, {name: sat}, hk, spine, ts)
    return found.select(
        hk,
        "snapshot_date",
        F.col(hk).alias(f"{name}_hk"),
        F.col(name).alias(f"{name}_load_date"),
        F.lit(now).cast("timestamp_ntz").alias(LOAD_DATE),
        F.lit(PIT_SOURCE).alias(RECORD_SOURCE),
    )


def stored_pit(spark: SparkSession, table: str) -> DataFrame:
    """A point-in-time table that ``refresh_pit`` keeps, without a job to look at it."""
    return spark.read.parquet(table).withColumn("snapshot_date", F.col("snapshot_date").cast("date"))


def refresh_pit(table: str, hub: DataFrame, sat: DataFrame, hk: str, name: str, now: str, changed_from: date | None = None, ts: str = LOAD_DATE) -> None:
    """Bring a stored point-in-time table, partitioned by day, up to date.

    ``changed_from`` is the earliest load day of what the satellite got since the
    last refresh, late rows included (None: all of it). The last day kept before it
    has a row for every key seen so far; these rows stand for the whole history, so
    only versions loaded after that day are read, and only later days are written,
    each in place of its old partition. A refresh repeated after a failure writes
    the same partitions again.
    """
    spark = sat.sparkSession
    days = sinks.partitions(spark, table, "snapshot_date")
    kept = [d for d in days if changed_from is not None and d < changed_from.isoformat()]
    if not kept:
        rows = pit(hub, sat, hk, name, now, ts=ts)
    else:
        last = F.lit(kept[-1]).cast("date")
        seeds = stored_pit(spark, table).where(F.col("snapshot_date") == last).select(hk, F.col(f"{name}_load_date").alias(ts))
        new = sat.where(F.col(ts) >= F.date_add(last, 1).cast("timestamp_ntz")).select(hk, ts)
        rows = pit(hub, seeds.unionByName(new), hk, name, now, snapshot_spine([new], ts), ts)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(table)


def pit_multi(
    hub: DataFrame, satellites: Mapping[str, DataFrame], hk: str, spine: DataFrame | None = None, ts: str = LOAD_DATE
) -> DataFrame:
    """Point-in-time table over several satellites; a row exists as soon as any
    of them has a version. One pass for all satellites, no joins between them."""
    found = _pointers(hub, satellites, hk, spine, ts)
    columns = []
    for name in satellites:
        columns.append(F.when(F.col(name).isNotNull(), F.col(hk)).alias(f"{name}_hk"))
        columns.append(F.col(name).alias(f"{name}_ldts"))
    return found.select(hk, "snapshot_date", *columns)


def pit_lookup(
    pit_table: DataFrame,
    sat: DataFrame,
    hk: str,
    snapshot: str | None = None,
    pointer: str = "sat_load_date",
    ts: str = LOAD_DATE,
) -> DataFrame:
    """Satellite attributes as of a snapshot day (of every day without one).

    Joins on the key *and* the load date the table points to; on the key alone
    every version of the key would come back.
    """
    rows = pit_table if snapshot is None else pit_table.where(F.col("snapshot_date") == F.lit(snapshot).cast("date"))
    wanted = rows.select(hk, "snapshot_date", F.col(pointer).alias(ts))
    return wanted.join(sat, [hk, ts])


def bridge(anchor: DataFrame, anchor_hk: str, links: Sequence[tuple[DataFrame, str, Sequence[str]]]) -> DataFrame:
    """Anchor hub joined with its links: all hub keys, link keys and the anchor's metadata.

    ``links`` holds (link, link key, other hub keys). A key that is in several
    links combines their rows, as the chained inner joins of a bridge do.
    """
    result = anchor.select(anchor_hk, LOAD_DATE, RECORD_SOURCE)
    keys: list[str] = []
    link_keys: list[str] = []
    for link, link_hk, other_hks in links:
        result = with_partners(result, link.select(anchor_hk, link_hk, *other_hks), [anchor_hk])
        keys += other_hks
        link_keys.append(link_hk)
    return result.select(anchor_hk, *keys, *link_keys, LOAD_DATE, RECORD_SOURCE)
