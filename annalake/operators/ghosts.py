"""Sentinel rows: one for unknown and one for invalid business keys."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalake.functions.hashing import ERROR_KEY, ZERO_KEY
from annalake.specs import IS_CURRENT, LOAD_DATE, RECORD_SOURCE

# Contents of the sentinel rows.
GHOST_DATE = "1900-01-01"
GHOST_SOURCE = "SYSTEM"
HUB_GHOSTS = {
    ZERO_KEY: {"object_id": -1, "source_table": "GHOST_UNKNOWN"},
    ERROR_KEY: {"object_id": -2, "source_table": "GHOST_ERROR"},
}
SATELLITE_GHOSTS = {
    ZERO_KEY: {"name": "Unknown", IS_CURRENT: "Y"},
    ERROR_KEY: {"name": "Error", IS_CURRENT: "Y"},
}


def ghost_rows(table: DataFrame, hk: str, values: Mapping[str, Mapping[str, object]], hd: str | None = None) -> DataFrame:
    """The sentinel rows in the schema of ``table``; unnamed columns are NULL."""
    rows = [
        {hk: key, LOAD_DATE: GHOST_DATE, RECORD_SOURCE: GHOST_SOURCE, **({hd: key} if hd else {}), **given}
        for key, given in values.items()
    ]
    names = [f.name for f in table.schema.fields if f.name in rows[0]]
    texts = T.StructType([T.StructField(n, T.StringType()) for n in names])
    local = table.sparkSession.createDataFrame([tuple(str(row[n]) for n in names) for row in rows], texts)
    return local.select(
        *[
            (F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in table.schema.fields
        ]
    )


def insert_ghosts(table: DataFrame, hk: str, kind: str, hd: str | None = None) -> DataFrame:
    """``table`` with the sentinel rows it still lacks; a second call adds nothing.

    The guard reads only the two sentinel keys, a filter the scan can use.
    """
    if kind not in ("hub", "satellite"):
        raise ValueError("kind must be 'hub' or 'satellite'")
    ghosts = ghost_rows(table, hk, HUB_GHOSTS if kind == "hub" else SATELLITE_GHOSTS, hd)
    present = table.where(F.col(hk).isin(ZERO_KEY, ERROR_KEY)).select(F.col(hk)).distinct()
    return table.unionByName(ghosts.join(present, hk, "left_anti").select(*table.columns))
