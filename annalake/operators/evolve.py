"""Schema evolution of a stored satellite."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalake.functions.hashing import hash_diff
from annalake.operators.loads import load_satellite
from annalake.specs import LOAD_DATE, RECORD_SOURCE


def evolve(
    existing: DataFrame,
    hd: str,
    diff_columns: Sequence[str],
    add: Mapping[str, str] | None = None,
    drop: Sequence[str] = (),
    sep: str = "",
    staged: DataFrame | None = None,
    rebuild: bool = False,
    hk: str | None = None,
) -> DataFrame:
    """Bring a satellite to a new attribute list.

    By default history stays: new attributes (name to type) are back-filled
    with NULL, dropped ones go, and every stored row gets its diff recomputed
    over ``diff_columns``. Without the recomputation a changed list would make
    every key look changed at the next load. ``rebuild=True`` throws history
    away and returns the open versions of ``staged``.
    """
    if rebuild:
        if staged is None or hk is None:
            raise ValueError("a rebuild needs the staged rows and their key")
        rest = [c for c in staged.columns if c not in (hk, hd, LOAD_DATE, RECORD_SOURCE)]
        return load_satellite(staged, hk, hd, rest)
    changed = existing.drop(*drop)
    new = {name: F.lit(None).cast(kind) for name, kind in (add or {}).items() if name not in changed.columns}
    if new:
        changed = changed.withColumns(new)
    return changed.withColumn(hd, hash_diff(changed, diff_columns, sep))
