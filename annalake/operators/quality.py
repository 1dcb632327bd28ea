"""Declarative data-quality checks and reconciliation reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalake.operators.matching import absent_from


@dataclass(frozen=True)
class Check:
    """One check on one column. ``test`` is not_null, unique, accepted_values
    (with ``values``) or relationships (with ``parent`` and ``field``)."""

    model: str
    column: str
    test: str
    values: tuple[str, ...] = ()
    parent: str = ""
    field: str = ""


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with their count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_records"))
    return counts.where("n_records > 1")


def accepted_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Values outside the accepted set, with their count; NULL is not a value."""
    outside = df.where(~F.col(column).isin(*values))
    return outside.groupBy(column).agg(F.count(F.lit(1)).alias("n_records"))


def relationships(child: DataFrame, column: str, parent: DataFrame, field: str) -> DataFrame:
    """Child rows whose non-NULL key has no parent."""
    keys = parent.select(F.col(field).alias(column))
    return absent_from(child.where(F.col(column).isNotNull()), keys, [column])


def orphans(sat: DataFrame, hub: DataFrame, hk: str) -> DataFrame:
    """Satellite rows whose key is missing in the hub."""
    return absent_from(sat, hub, [hk])


def _groups(checks: Sequence[Check]) -> list[tuple[int, int]]:
    """(group, place in it) of every check. Relationships with the same parent's field
    and a unique check of that field look at the same values and are a group, any
    other check is one of its own."""
    fields = {(c.parent, c.field) for c in checks if c.test == "relationships"}
    numbers: dict[tuple, int] = {}
    sizes: dict[int, int] = {}
    places = []
    for i, c in enumerate(checks):
        name: tuple = (i,)
        if c.test == "relationships":
            name = (c.parent, c.field)
        elif c.test == "unique" and (c.model, c.column) in fields:
            name = (c.model, c.column)
        group = numbers.setdefault(name, len(numbers))
        places.append((group, sizes.get(group, 0)))
        sizes[group] = places[-1][1] + 1
    return places


def _short(value: Column) -> Column:
    """Text as bytes, or as the 32 bytes of its SHA-256 where it isn't shorter than those."""
    return F.when(F.octet_length(value) < 32, value.cast("binary")).otherwise(F.unhex(F.sha2(value.cast("binary"), 256)))


def _records(df: DataFrame, model: str, checks: Sequence[Check], places: Sequence[tuple[int, int]], width: int) -> DataFrame:
    """(group, value, n0.., known) for all that the checks ask of one table, in one scan:
    values that are missing, not accepted, or to be counted, and parents' keys. What
    looks at the same values of a column shares a record."""
    wanted: dict[tuple, set[int]] = {}
    for check, (group, place) in zip(checks, places):
        if check.model == model:
            test = check.test if check.test in ("not_null", "accepted_values") else "given"
            wanted.setdefault((group, check.column, test, check.values), set()).add(place)
        if check.test == "relationships" and check.parent == model:
            wanted.setdefault((group, check.field, "given", ()), set()).add(-1)

    def holds(column: Column, test: str, values: tuple[str, ...]) -> Column:
        return column.isNull() if test == "not_null" else ~column.isin(*values) if test == "accepted_values" else column.isNotNull()

    shown = []
    for (group, name, test, values), asked in wanted.items():
        column = F.col(name)
        counts = [F.lit(int(i in asked)).cast("bigint").alias(f"n{i}") for i in range(width)]
        record = F.struct(F.lit(group).alias("group"), _short(column.cast("string")).alias("value"), *counts, F.lit(-1 in asked).alias("known"))
        shown.append(F.when(holds(column, test, values), record))
    return df.select(F.inline(F.array_compact(F.array(*shown))))


def run_checks(tables: Mapping[str, DataFrame], checks: Sequence[Check]) -> DataFrame:
    """(model, column_name, test, failures) for a whole suite.

    Failures are rows for not_null and relationships, distinct values for
    unique and accepted_values. Every table is scanned once, whatever number of
    checks look at it, as child or as parent; one aggregation by group of checks and
    value serves them all, so a hot key travels as one row a task, and a parent's key
    once however many children it has. A key without a parent is a value that no
    parent's record has.
    """
    unknown = {c.test for c in checks} - {"not_null", "unique", "accepted_values", "relationships"}
    if unknown:
        raise ValueError(f"unknown tests {sorted(unknown)}")
    models = dict.fromkeys([c.model for c in checks] + [c.parent for c in checks if c.test == "relationships"])
    places = _groups(checks)
    width = 1 + max(place for _, place in places)
    codes = [group * width + place for group, place in places]
    records = reduce(DataFrame.unionByName, [_records(tables[m], m, checks, places, width) for m in models])
    counted = records.groupBy("group", "value").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(width)], F.max("known").alias("known"))
    asked = [
        F.when(F.col(f"n{i}") > 0, F.struct((F.col("group") * width + i).alias("check"), F.col(f"n{i}").alias("n"), F.col("known").alias("known")))
        for i in range(width)
    ]
    counted = counted.select(F.inline(F.array_compact(F.array(*asked))))

    def of(test: str) -> Column:
        return F.col("check").isin([code for code, c in zip(codes, checks) if c.test == test])

    failures = (
        F.when(of("not_null"), F.col("n"))
        .when(of("unique"), (F.col("n") > 1).cast("bigint"))
        .when(of("accepted_values"), F.lit(1))
        .when(~F.col("known"), F.col("n"))
    )
    found = counted.groupBy("check").agg(F.sum(failures).alias("failures"))
    names = [F.struct(F.lit(code).alias("check"), F.lit(c.model).alias("model"), F.lit(c.column).alias("column_name"), F.lit(c.test).alias("test")) for code, c in zip(codes, checks)]
    suite = records.sparkSession.range(1).select(F.inline(F.array(*names)))
    return suite.join(found, "check", "left").select("model", "column_name", "test", F.coalesce("failures", F.lit(0)).cast("bigint").alias("failures"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_records")).where("n_records > 1")


def table_stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows), one counting pass per table."""
    return reduce(
        DataFrame.unionByName,
        [
            df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
            for name, df in tables.items()
        ],
    )


def load_reconciliation(pairs: Sequence[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """Row counts of source and vault per layer, with their difference."""
    parts = []
    for layer, source, target in pairs:
        counted = [
            source.agg(F.count(F.lit(1)).alias("n")).select(F.col("n").alias("source_rows"), F.lit(0).cast("bigint").alias("vault_rows")),
            target.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).cast("bigint").alias("source_rows"), F.col("n").alias("vault_rows")),
        ]
        both = counted[0].unionByName(counted[1]).agg(F.sum("source_rows").alias("source_rows"), F.sum("vault_rows").alias("vault_rows"))
        parts.append(both.select(F.lit(layer).alias("layer"), "source_rows", "vault_rows", (F.col("vault_rows") - F.col("source_rows")).alias("difference")))
    return reduce(DataFrame.unionByName, parts)


def count_where(df: DataFrame, condition) -> DataFrame:
    return df.where(condition).agg(F.count(F.lit(1)).alias("n"))


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
