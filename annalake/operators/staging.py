"""Staging: union of tagged feeds, hashes and load metadata in one projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalake.functions.hashing import hash_diff, hash_key
from annalake.sources.readers import conform
from annalake.specs import LOAD_DATE, RECORD_SOURCE, RUN_ID, StageSpec


@dataclass(frozen=True)
class Feed:
    """One source feed and the constants that tag its rows."""

    df: DataFrame
    tags: Mapping[str, str] = field(default_factory=dict)


def union_sources(feeds: Sequence[Feed], schema: T.StructType) -> DataFrame:
    """UNION ALL of feeds brought to one schema.

    Every branch is cast before the union: left to itself the union widens
    decimals to the larger integer part and rounds fractions away.
    """
    branches = [
        conform(feed.df, schema).withColumns({tag: F.lit(value) for tag, value in feed.tags.items()})
        for feed in feeds
    ]
    return reduce(DataFrame.unionByName, branches)


def load_date_column(now: str, column: str = LOAD_DATE) -> Column:
    """Parsed load date; unreadable or missing text falls back to ``now``."""
    parsed = F.col(column).try_cast("timestamp_ntz")
    return F.coalesce(parsed, F.lit(now).cast("timestamp_ntz"))


def load_metadata(df: DataFrame, default_source: str, now: str) -> DataFrame:
    return df.withColumns(
        {
            RECORD_SOURCE: F.coalesce(F.col(RECORD_SOURCE), F.lit(default_source)),
            LOAD_DATE: load_date_column(now),
        }
    )


def derived_columns(df: DataFrame, definitions: Mapping[str, str]) -> DataFrame:
    """Add columns: ``!text`` is the constant ``text``, anything else an SQL expression."""
    return df.withColumns(
        {
            name: F.lit(text[1:]) if text.startswith("!") else F.expr(text)
            for name, text in definitions.items()
        }
    )


def stage(df: DataFrame, spec: StageSpec) -> DataFrame:
    """Hash keys, hash diffs, business keys, payload and metadata in one select."""
    source = derived_columns(df, spec.derived) if spec.derived else df
    columns: list[Column] = []
    for name, h in spec.keys.items():
        columns.append(hash_key(source, h.columns, h.separator, h.algorithm, h.encoding).alias(name))
    for name, h in spec.diffs.items():
        columns.append(hash_diff(source, h.columns, h.separator, h.algorithm, h.encoding).alias(name))
    plain = [*spec.business_keys, *[c for c in spec.payload if c not in spec.business_keys], *spec.extra]
    columns += [F.col(f"`{c}`") for c in plain]
    columns += [
        F.coalesce(F.col(RECORD_SOURCE), F.lit(spec.default_source)).alias(RECORD_SOURCE),
        load_date_column(spec.now).alias(LOAD_DATE),
        F.col(RUN_ID),
    ]
    return source.select(*columns)
