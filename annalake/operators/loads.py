"""Incremental loads: which staged rows a hub, link or satellite still lacks.

Every loader returns the rows to append; ``existing=None`` is the first load
(or a full refresh) and skips the anti join. Duplicates are folded before the
join wherever the result allows it, so a key that fills a third of the batch
reaches the shuffle as a handful of rows, and stored satellites are probed with
one row per key. What remains hot on the staged side is split by AQE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalake.functions.hashing import digest, text_of
from annalake.operators.matching import absent_from
from annalake.specs import (
    END_DATE,
    IS_ACTIVE,
    IS_CURRENT,
    LOAD_DATE,
    RECORD_SOURCE,
    START_DATE,
)


def _present(cols: Sequence[str]) -> Column:
    condition = F.lit(True)
    for c in cols:
        condition = condition & F.col(c).isNotNull()
    return condition


def open_version(df: DataFrame) -> DataFrame:
    return df.withColumns({IS_CURRENT: F.lit("Y"), END_DATE: F.lit(None).cast("timestamp_ntz")})


def load_hub(
    staged: DataFrame, hk: str, business_keys: Sequence[str], existing: DataFrame | None = None
) -> DataFrame:
    """New hub rows. Load date and source belong to the distinct row, so one
    batch holding a key under two load dates yields two rows."""
    rows = staged.where(_present([hk])).select(hk, *business_keys, LOAD_DATE, RECORD_SOURCE).distinct()
    return rows if existing is None else absent_from(rows, existing, [hk])


def load_link(
    staged: DataFrame,
    link_hk: str,
    hub_hks: Sequence[str],
    existing: DataFrame | None = None,
    extra: Sequence[str] = (),
    not_null: Sequence[str] = (),
) -> DataFrame:
    """New link rows; ``not_null`` names foreign keys that must be given."""
    rows = (
        staged.where(_present([*hub_hks, *not_null]))
        .select(link_hk, *hub_hks, *extra, LOAD_DATE, RECORD_SOURCE)
        .distinct()
    )
    return rows if existing is None else absent_from(rows, existing, [link_hk])


def latest_diff(sat: DataFrame, hk: str, hd: str) -> DataFrame:
    """The distinct hash diffs at every key's newest load date: rows tied there all count."""
    dated = sat.groupBy(hk, hd).agg(F.max(LOAD_DATE).alias("_at"))
    newest = dated.groupBy(F.col(hk).alias("_key")).agg(F.max("_at").alias("_newest"))
    return dated.join(newest, (F.col(hk) == F.col("_key")) & (F.col("_at") == F.col("_newest")), "left_semi").select(hk, hd)


def load_satellite(
    staged: DataFrame,
    hk: str,
    hd: str,
    payload: Sequence[str],
    existing: DataFrame | None = None,
    compare: str = "any",
) -> DataFrame:
    """New satellite versions, open ('Y', no end date).

    ``compare="any"`` looks at the key's whole history, so a value that
    returns to an earlier state adds nothing; ``"latest"`` compares with the
    newest version only and keeps such reversions. Rows are not deduplicated.
    """
    rows = staged.where(_present([hk])).select(hk, hd, LOAD_DATE, RECORD_SOURCE, *[f"`{c}`" for c in payload])
    if existing is not None and compare == "latest":
        existing = latest_diff(existing, hk, hd)
    elif compare not in ("any", "latest"):
        raise ValueError("compare must be 'any' or 'latest'")
    return open_version(rows if existing is None else absent_from(rows, existing, [hk, hd]))


def load_subset_satellite(
    staged: DataFrame,
    hk: str,
    hd: str,
    payload: Sequence[str],
    where: Column,
    existing: DataFrame | None = None,
    compare: str = "any",
) -> DataFrame:
    """Satellite on the rows matching ``where``, with its own hash diff."""
    subset = staged.where(where)
    parts = [text_of(subset, c) for c in payload]
    subset = subset.withColumn(hd, digest(parts[0] if len(parts) == 1 else F.concat(*parts)))
    return load_satellite(subset, hk, hd, payload, existing, compare)


def load_eff_satellite(
    staged: DataFrame,
    link_hk: str,
    driving_hk: str,
    hub_hks: Sequence[str],
    existing: DataFrame | None = None,
    mode: str = "active",
) -> DataFrame:
    """New relationship periods, open.

    ``mode="active"`` compares with the active rows only, so a relationship
    that ended may start again. ``mode="driving_start"`` compares driving key
    and start date and does not deduplicate.
    """
    rows = staged.where(_present([link_hk, *hub_hks])).select(
        link_hk,
        *hub_hks,
        F.col(LOAD_DATE).alias(START_DATE),
        F.lit(None).cast("timestamp_ntz").alias(END_DATE),
        F.lit("Y").alias(IS_ACTIVE),
        RECORD_SOURCE,
    )
    if mode == "active":
        if existing is None:
            return rows.distinct()
        # Periods differ by their start, so folding them first would shuffle most rows twice.
        return absent_from(rows, existing.where(F.col(IS_ACTIVE) == "Y"), [link_hk], distinct=True)
    if mode == "driving_start":
        return rows if existing is None else absent_from(rows, existing, [driving_hk, START_DATE])
    raise ValueError("mode must be 'active' or 'driving_start'")
