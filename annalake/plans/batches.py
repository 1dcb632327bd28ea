"""A vault kept on shared storage and loaded batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from annalake.operators import history, loads
from annalake.sources import sinks
from annalake.specs import START_DATE, EffSatelliteSpec, HubSpec, LinkSpec, SatelliteSpec


# Table loads of one batch submitted at the same time.
PARALLEL_TABLES = 8


@dataclass(frozen=True)
class VaultSpec:
    hubs: Sequence[HubSpec] = ()
    links: Sequence[LinkSpec] = ()
    satellites: Sequence[SatelliteSpec] = ()
    eff_satellites: Sequence[EffSatelliteSpec] = ()


@dataclass(frozen=True)
class Vault:
    """Hubs, links and satellites below one folder.

    Rows are only ever appended, one folder per load; flags and end dates are
    derived when a satellite is read. A load compares with the loads before
    it and rewrites its own folder, so running it again after a failure, or
    replaying a micro-batch, changes nothing.

    ``strict=True`` also keeps each satellite with flags as an in-place update
    after every load leaves them, one version per load; for batches in load
    date order both readings agree.
    """

    spark: SparkSession
    root: str
    spec: VaultSpec
    strict: bool = False

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def rows(self, name: str, before: int | None = None, schema: T.StructType | None = None) -> DataFrame | None:
        return sinks.read_appended(self.spark, self._path(name), before, schema)

    def load(self, staged: DataFrame, load_id: int) -> None:
        """Apply one staged batch. The tables do not depend on one another, so
        their jobs are submitted together and share the cluster."""
        staged = staged.persist(StorageLevel.MEMORY_AND_DISK)
        steps = [
            *[partial(self._load_hub, staged, hub, load_id) for hub in self.spec.hubs],
            *[partial(self._load_link, staged, link, load_id) for link in self.spec.links],
            *[partial(self._load_satellite, staged, sat, load_id) for sat in self.spec.satellites],
            *[partial(self._load_eff_satellite, staged, eff, load_id) for eff in self.spec.eff_satellites],
        ]
        try:
            with ThreadPoolExecutor(max_workers=PARALLEL_TABLES) as pool:
                for running in [pool.submit(step) for step in steps]:
                    running.result()
        finally:
            staged.unpersist()

    def _append(self, name: str, load_id: int, new_rows: Callable[[DataFrame | None], DataFrame]) -> None:
        """Append what ``new_rows`` finds missing in the loads before this one."""
        everything = new_rows(None)
        existing = self.rows(name, load_id, everything.schema)
        new = everything if existing is None else new_rows(existing)
        sinks.write_append(new, self._path(name), load_id)

    def _load_hub(self, staged: DataFrame, hub: HubSpec, load_id: int) -> None:
        self._append(hub.name, load_id, partial(loads.load_hub, staged, hub.hk, hub.business_keys))

    def _load_link(self, staged: DataFrame, link: LinkSpec, load_id: int) -> None:
        args = (staged, link.link_hk, link.hub_hks)
        self._append(link.name, load_id, partial(loads.load_link, *args, extra=link.extra, not_null=link.not_null))

    def _load_satellite(self, staged: DataFrame, sat: SatelliteSpec, load_id: int) -> None:
        args = (staged, sat.hk, sat.hd, sat.payload)
        self._append(sat.name, load_id, partial(loads.load_satellite, *args, compare=sat.compare))
        if self.strict:
            self._update_state(sat, load_id)

    def _load_eff_satellite(self, staged: DataFrame, eff: EffSatelliteSpec, load_id: int) -> None:
        new_rows = partial(loads.load_eff_satellite, staged, eff.link_hk, eff.driving_hk, eff.hub_hks, mode=eff.mode)
        if eff.mode != "active":
            self._append(eff.name, load_id, new_rows)
            return
        schema = new_rows().schema
        active = self.active(eff, load_id, schema)
        path = self._path(eff.name)
        sinks.write_append(new_rows(active), path, load_id)
        new = self.spark.read.schema(schema).parquet(f"{path}/load_id={load_id}")
        rows = new if active is None else active.unionByName(new)
        sinks.write_overwrite(history.newest(rows, eff.driving_hk, START_DATE), f"{path}_active", version=load_id)
        sinks.drop_versions(self.spark, f"{path}_active")

    def active(self, eff: EffSatelliteSpec, before: int | None = None, schema: T.StructType | None = None) -> DataFrame | None:
        """The relationships in force (before a load): those at their driving key's
        latest start. Every load keeps them as a version, made of the version before
        and its own rows, so its input is bounded by them and the batch, not by the
        history. Where no version is left, for a load run again after later ones,
        they are derived from all rows."""
        kept = sinks.read_current(self.spark, f"{self._path(eff.name)}_active", before, schema)
        if kept is not None:
            return kept
        rows = self.rows(eff.name, before, schema)
        return None if rows is None else history.newest(rows, eff.driving_hk, START_DATE)

    def _update_state(self, sat: SatelliteSpec, load_id: int) -> None:
        state = f"{self._path(sat.name)}_state"
        new = self.spark.read.parquet(f"{self._path(sat.name)}/load_id={load_id}")
        before = sinks.read_current(self.spark, state, load_id, new.schema)
        rows = new if before is None else before.unionByName(new)
        sinks.write_overwrite(history.close_open_only(rows, sat.hk), state, version=load_id)
        sinks.drop_versions(self.spark, state)

    def compact(self, upto: int) -> None:
        """Fold the loads up to a number; those that may still be repeated come after it."""
        for spec in (*self.spec.hubs, *self.spec.links, *self.spec.satellites, *self.spec.eff_satellites):
            sinks.compact(self.spark, self._path(spec.name), upto)

    def run(self, batches: Iterable[DataFrame], first_id: int = 0) -> None:
        """Load staged batches in order."""
        for load_id, staged in enumerate(batches, first_id):
            self.load(staged, load_id)

    def satellite(self, sat: SatelliteSpec) -> DataFrame:
        """Satellite with current flags and end dates."""
        return history.close_versions(self.rows(sat.name), sat.hk)

    def satellite_state(self, sat: SatelliteSpec) -> DataFrame:
        """Satellite as in-place updates after every load would have left it."""
        return sinks.read_current(self.spark, f"{self._path(sat.name)}_state")

    def eff_satellite(self, eff: EffSatelliteSpec) -> DataFrame:
        return history.close_relationships(self.rows(eff.name), eff.driving_hk)
