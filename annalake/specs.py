"""Declarative descriptions of staging models and vault tables.

The constructors enforce the naming rules of the data model, so a spec that
builds is a spec whose tables follow the conventions.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

# Metadata columns and naming conventions of the data model.
LOAD_DATE = "dss_load_date"
RECORD_SOURCE = "dss_record_source"
RUN_ID = "dss_run_id"
IS_CURRENT = "dss_is_current"
END_DATE = "dss_end_date"
START_DATE = "dss_start_date"
IS_ACTIVE = "dss_is_active"
BUSINESS_KEY_SUFFIXES = ("_id", "_code", "_number", "_key")

_ENTITY = r"[a-z][a-z0-9_]*"


def require_name(name: str, prefix: str) -> str:
    if not re.fullmatch(prefix + _ENTITY, name):
        raise ValueError(f"{name!r} must be {prefix!r} followed by a lower-case name")
    return name


def warn_business_keys(names: Sequence[str]) -> None:
    for name in names:
        if not name.endswith(BUSINESS_KEY_SUFFIXES):
            warnings.warn(f"business key {name!r} should end in one of {BUSINESS_KEY_SUFFIXES}", stacklevel=3)


@dataclass(frozen=True)
class HashSpec:
    """How one hash column is computed from which columns."""

    columns: Sequence[str]
    separator: str = "^^"
    algorithm: str = "SHA"
    encoding: str = "UTF-8"


@dataclass(frozen=True)
class StageSpec:
    """A staging model: hashes, business keys, payload and load metadata."""

    name: str
    keys: Mapping[str, HashSpec]
    diffs: Mapping[str, HashSpec]
    business_keys: Sequence[str]
    payload: Sequence[str]
    default_source: str
    now: str
    derived: Mapping[str, str] = field(default_factory=dict)
    extra: Sequence[str] = ()

    def __post_init__(self) -> None:
        require_name(self.name, "stg_")
        for key in self.keys:
            require_name(key, "hk_")
        for diff in self.diffs:
            require_name(diff, "hd_")


@dataclass(frozen=True)
class HubSpec:
    name: str
    hk: str
    business_keys: Sequence[str]

    def __post_init__(self) -> None:
        require_name(self.name, "hub_")
        require_name(self.hk, "hk_")
        warn_business_keys([k for k in self.business_keys if k != "source_table"])


@dataclass(frozen=True)
class LinkSpec:
    name: str
    link_hk: str
    hub_hks: Sequence[str]
    extra: Sequence[str] = ()
    not_null: Sequence[str] = ()

    def __post_init__(self) -> None:
        require_name(self.name, "link_")
        require_name(self.link_hk, "hk_link_")
        if len(self.hub_hks) < 2:
            raise ValueError(f"{self.name}: a link joins at least two hubs")
        for hk in self.hub_hks:
            require_name(hk, "hk_")


@dataclass(frozen=True)
class SatelliteSpec:
    """Satellite; ``hk`` is the parent hub's key, whatever the satellite's own name."""

    name: str
    hk: str
    hd: str
    payload: Sequence[str]
    compare: str = "any"

    def __post_init__(self) -> None:
        require_name(self.name, "sat_")
        require_name(self.hk, "hk_")
        require_name(self.hd, "hd_")
        if self.compare not in ("any", "latest"):
            raise ValueError("compare must be 'any' or 'latest'")


@dataclass(frozen=True)
class EffSatelliteSpec:
    name: str
    link_hk: str
    driving_hk: str
    hub_hks: Sequence[str]
    mode: str = "active"

    def __post_init__(self) -> None:
        require_name(self.name, "eff_sat_")
        require_name(self.link_hk, "hk_link_")
        if self.driving_hk not in self.hub_hks:
            raise ValueError(f"{self.name}: the driving key must be one of the hub keys")
        if self.mode not in ("active", "driving_start"):
            raise ValueError("mode must be 'active' or 'driving_start'")
