"""Flat reporting views over hubs, satellites and links."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalake.operators.history import current
from annalake.operators.matching import with_optional
from annalake.specs import LOAD_DATE

# Prefixes of columns that are not payload.
TECHNICAL_PREFIXES = ("hk_", "hd_", "dss_")


@dataclass(frozen=True)
class SatelliteSource:
    """A satellite to show; ``hk`` is its parent key when it differs from the
    hub's, ``many`` says that one key may own a large share of the shown rows
    (all versions, or very many tied ones)."""

    name: str
    df: DataFrame
    columns: Sequence[str] = ("*",)
    current_only: bool = True
    hk: str | None = None
    many: bool = False


@dataclass(frozen=True)
class LinkSource:
    """A link to follow, and the target hub's satellite to show; ``many`` says
    that one hub key may own a large share of the links."""

    name: str
    df: DataFrame
    target_hk: str
    target: SatelliteSource | None = None
    many: bool = False


def expand_star(sat: DataFrame) -> list[str]:
    """Payload columns: everything but keys, diffs and metadata."""
    return [c for c in sat.columns if not c.startswith(TECHNICAL_PREFIXES)]


def entity_of(satellite: str) -> str:
    for prefix in ("eff_sat_", "sat_"):
        if satellite.startswith(prefix):
            return satellite[len(prefix) :]
    return satellite


def unique_aliases(requests: Sequence[tuple[str, str]], reserved: Sequence[str]) -> list[str]:
    """One distinct name per (satellite, column), in order.

    A taken name gets the entity as prefix, then a counter from 2.
    """
    used = set(reserved)
    result = []
    for satellite, column in requests:
        prefixed = f"{entity_of(satellite)}_{column}"
        candidates = [column, prefixed]
        name = next((c for c in candidates if c not in used), None)
        counter = 2
        while name is None:
            if f"{prefixed}{counter}" not in used:
                name = f"{prefixed}{counter}"
            counter += 1
        used.add(name)
        result.append(name)
    return result


def _shown_columns(source: SatelliteSource) -> list[str]:
    wanted = list(source.columns)
    return expand_star(source.df) if not wanted or "*" in wanted else wanted


def _projection(source: SatelliteSource, hk: str, aliases: dict[tuple[str, str], str]) -> DataFrame:
    rows = current(source.df) if source.current_only else source.df
    shown = [F.col(f"`{c}`").alias(aliases[(source.name, c)]) for c in _shown_columns(source)]
    return rows.select(F.col(source.hk or hk).alias(hk), *shown)


def mart(
    hub: DataFrame,
    hk: str,
    satellites: Sequence[SatelliteSource],
    links: Sequence[LinkSource] = (),
    exclude_ghosts: bool = True,
    hub_columns: Sequence[str] = ("object_id",),
) -> DataFrame:
    """Hub left-joined with satellites and, through links, their targets.

    Satellites are reduced to the wanted columns and rows before they are
    joined, and joins on the hub's key follow one another so that its
    partitioning is used for all of them. ``exclude_ghosts`` keeps
    ``object_id > 0``, which also drops NULL and key 0. A link without validity
    repeats a key that has several targets.
    """
    targets = [link.target for link in links if link.target is not None]
    requests = [(s.name, c) for s in [*satellites, *targets] for c in _shown_columns(s)]
    names = unique_aliases(requests, [*hub_columns, hk, "hub_load_date"])
    aliases = dict(zip(requests, names, strict=True))

    base = hub.where(F.col("object_id") > 0) if exclude_ghosts else hub
    result = base.select(hk, *hub_columns, F.col(LOAD_DATE).alias("hub_load_date"))
    for source in satellites:
        result = with_optional(result, _projection(source, hk, aliases), [hk], source.many)
    for link in links:
        result = with_optional(result, link.df.select(hk, link.target_hk), [hk], link.many)
    for link in links:
        if link.target is not None:
            result = with_optional(
                result, _projection(link.target, link.target_hk, aliases), [link.target_hk], link.target.many
            )
    return result.select(hk, *hub_columns, *names, "hub_load_date")


def top_n(view: DataFrame, order: Sequence[Column], n: int, tiebreak: str) -> DataFrame:
    """The first ``n`` rows of a view in a total order."""
    return view.orderBy(*order, F.col(tiebreak).asc()).limit(n)


def in_target(
    sat: DataFrame, link: DataFrame, target_sat: DataFrame, hk: str, target_hk: str, name: str, target_label: str
) -> DataFrame:
    """Current rows of ``sat`` linked to the target called ``name``."""
    target = target_sat.where(F.col("name") == name).select(target_hk, F.col("name").alias(target_label))
    linked = link.select(hk, target_hk).join(target, target_hk)
    return current(sat).select(hk, "name").join(linked, hk).select("name", target_label)
