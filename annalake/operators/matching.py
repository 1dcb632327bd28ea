"""Joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _match(rows: DataFrame, others: DataFrame, keys: Sequence[str], how: str, distinct: bool = False) -> DataFrame:
    """Keys are folded to one row each before they are shuffled. Folding leaves
    them partitioned by key, the join would take them as they lie, and adaptive
    execution splits an oversized partition only where both sides come from a
    shuffle of the join itself. A fingerprint of the key, joined along with it,
    asks for that shuffle; it carries keys only. Distinct rows are found where the
    join has put them, before the fingerprint goes."""
    names = list(keys)
    fingerprint = F.xxhash64(*names)
    probe = others.select(*names).distinct().withColumn("_fingerprint", fingerprint)
    joined = rows.withColumn("_fingerprint", fingerprint).join(probe, [*names, "_fingerprint"], how)
    joined = joined.distinct() if distinct else joined
    return joined.select(*[f"`{c}`" for c in rows.columns])


def present_in(rows: DataFrame, others: DataFrame, keys: Sequence[str], distinct: bool = False) -> DataFrame:
    """Rows whose key occurs in ``others``."""
    return _match(rows, others, keys, "left_semi", distinct)


def absent_from(rows: DataFrame, others: DataFrame, keys: Sequence[str], distinct: bool = False) -> DataFrame:
    """Rows whose key does not occur in ``others``; a NULL key occurs nowhere."""
    return _match(rows, others, keys, "left_anti", distinct)


def with_partners(rows: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` JOIN ``others``, splittable along either side even where ``rows``
    comes from a join on the same key and would be taken as it lies."""
    names = list(keys)
    left, right = (df.withColumn("_fingerprint", F.xxhash64(*names)) for df in (rows, others))
    return left.join(right, [*names, "_fingerprint"]).drop("_fingerprint")


def with_optional(rows: DataFrame, others: DataFrame, keys: Sequence[str], many: bool = False) -> DataFrame:
    """``rows`` LEFT JOIN ``others``.

    An outer join can be split along its preserved side only. Where one key may
    own a large share of the optional side, ``many`` joins in two parts: the
    rows that have partners by an inner join, which splits along either side,
    and the rows that have none.
    """
    names = list(keys)
    if not many:
        return rows.join(others, names, "left")
    alone = absent_from(rows, others, names)
    return with_partners(rows, others, names).unionByName(alone, allowMissingColumns=True)
