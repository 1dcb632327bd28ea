"""An entity from a handful of names: staging, hub, satellite and links."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalake.operators.staging import stage
from annalake.plans.batches import VaultSpec
from annalake.specs import (
    LOAD_DATE,
    RECORD_SOURCE,
    RUN_ID,
    EffSatelliteSpec,
    HashSpec,
    HubSpec,
    LinkSpec,
    SatelliteSpec,
    StageSpec,
)


@dataclass(frozen=True)
class EntitySpec:
    """``foreign_keys`` maps columns to the entities they point to; each one
    yields the target's hash key, a link and an effectivity satellite driven by
    this entity. ``diff`` lists the attributes that make a new version, all of
    them by default."""

    name: str
    business_keys: Sequence[str]
    attributes: Sequence[str]
    default_source: str
    now: str
    foreign_keys: Mapping[str, str] = field(default_factory=dict)
    diff: Sequence[str] | None = None
    diff_separator: str = ""
    encoding: str = "UTF-8"

    @property
    def hk(self) -> str:
        return f"hk_{self.name}"

    @property
    def hd(self) -> str:
        return f"hd_{self.name}"

    def link_hk(self, target: str) -> str:
        return f"hk_link_{self.name}_{target}"

    def staging(self) -> StageSpec:
        keys = {self.hk: HashSpec(self.business_keys, encoding=self.encoding)}
        for column, target in self.foreign_keys.items():
            keys[f"hk_{target}"] = HashSpec((column,), encoding=self.encoding)
            keys[self.link_hk(target)] = HashSpec((*self.business_keys, column), encoding=self.encoding)
        compared = self.attributes if self.diff is None else self.diff
        return StageSpec(
            name=f"stg_{self.name}",
            keys=keys,
            diffs={self.hd: HashSpec(compared, self.diff_separator, encoding=self.encoding)},
            business_keys=self.business_keys,
            payload=[*self.attributes, *[c for c in self.foreign_keys if c not in self.attributes]],
            default_source=self.default_source,
            now=self.now,
        )

    def vault(self) -> VaultSpec:
        targets = list(self.foreign_keys.items())
        return VaultSpec(
            hubs=(HubSpec(f"hub_{self.name}", self.hk, self.business_keys),),
            satellites=(SatelliteSpec(f"sat_{self.name}", self.hk, self.hd, self.attributes),),
            links=tuple(
                LinkSpec(f"link_{self.name}_{t}", self.link_hk(t), (self.hk, f"hk_{t}"), not_null=(column,))
                for column, t in targets
            ),
            eff_satellites=tuple(
                EffSatelliteSpec(f"eff_sat_{self.name}_{t}", self.link_hk(t), self.hk, (self.hk, f"hk_{t}"))
                for _, t in targets
            ),
        )

    def stage(self, source: DataFrame) -> DataFrame:
        """Stage a source; load columns it does not have count as NULL."""
        missing = [c for c in (RECORD_SOURCE, LOAD_DATE, RUN_ID) if c not in source.columns]
        filled = source.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else source
        return stage(filled, self.staging())

    def evolve(
        self,
        add: Sequence[str] = (),
        drop: Sequence[str] = (),
        diff_add: Sequence[str] = (),
        diff_drop: Sequence[str] = (),
        foreign_keys: Mapping[str, str] | None = None,
    ) -> EntitySpec:
        """The entity with attributes, compared attributes or foreign keys changed.

        New attributes take part in the comparison; ``operators.evolve`` brings
        stored satellites along.
        """
        compared = list(self.attributes if self.diff is None else self.diff)
        gone = {*drop, *diff_drop}
        return replace(
            self,
            attributes=tuple([c for c in self.attributes if c not in drop] + list(add)),
            diff=tuple([c for c in compared if c not in gone] + [c for c in (*add, *diff_add) if c not in gone]),
            foreign_keys={**self.foreign_keys, **(foreign_keys or {})},
        )
