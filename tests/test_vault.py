"""Loads, replays and history on hand-made batches and against batch-by-batch runs."""

import datetime
import random
from contextlib import contextmanager

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annalake.operators import evolve, ghosts, history, loads, replay
from annalake.functions.hashing import hash_diff, hash_key, link_hash_key
from annalake.plans import fixtures as fx
from annalake.plans import queries
from annalake.plans.batches import Vault, VaultSpec
from annalake.plans.entity import EntitySpec
from annalake.specs import EffSatelliteSpec, HubSpec, LinkSpec, SatelliteSpec

SAT = SatelliteSpec("sat_item", "hk_item", "hd_item", ("value",))
LATEST = SatelliteSpec("sat_item_latest", "hk_item", "hd_item", ("value",), "latest")
HUB = HubSpec("hub_item", "hk_item", ("item_id",))
LINK = LinkSpec("link_item_place", "hk_link_item_place", ("hk_item", "hk_place"), not_null=("value",))
EFF = EffSatelliteSpec("eff_sat_item_place", "hk_link_item_place", "hk_item", ("hk_item", "hk_place"))
EFF_START = EffSatelliteSpec("eff_sat_item_start", "hk_link_item_place", "hk_item", ("hk_item", "hk_place"), "driving_start")


def day(n, hour=0):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n - 1, hours=hour)


def staged(spark, rows):
    """(key, value, load date) rows, staged; the value doubles as the related place."""
    df = spark.createDataFrame(
        [(k, v, ts, "test", ts.date()) for k, v, ts in rows],
        "item_id bigint, value string, dss_load_date timestamp_ntz, dss_record_source string, batch date",
    )
    return df.select(
        "*",
        hash_key(df, "item_id").alias("hk_item"),
        hash_key(df, "value").alias("hk_place"),
        link_hash_key(df, ["item_id"], ["value"]).alias("hk_link_item_place"),
        hash_diff(df, ["value"]).alias("hd_item"),
    )


def sat_load(spark, rows, existing=None, spec=SAT):
    return loads.load_satellite(staged(spark, rows), spec.hk, spec.hd, spec.payload, existing, spec.compare)


def versions(df):
    return sorted((r["value"], r["dss_load_date"], r["dss_is_current"], r["dss_end_date"]) for r in df.collect())


def test_hub_keeps_one_row_per_load_date_within_a_batch(spark):
    batch = staged(spark, [(1, "A", day(1)), (1, "B", day(1)), (1, "C", day(2))])
    hub = loads.load_hub(batch, "hk_item", ["item_id"])
    assert hub.count() == 2
    assert loads.load_hub(batch, "hk_item", ["item_id"], hub).count() == 0


def test_reversion_is_lost_by_default_and_kept_against_the_latest(spark):
    steps = [[(1, "A", day(1))], [(1, "B", day(2))], [(1, "A", day(3))]]
    for spec, expected in ((SAT, 2), (LATEST, 3)):
        table = sat_load(spark, steps[0], spec=spec)
        for step in steps[1:]:
            table = table.unionByName(sat_load(spark, step, table, spec))
        closed = history.close_versions(table, "hk_item")
        assert closed.count() == expected
        current = history.current(closed).collect()
        assert [r.value for r in current] == ["B" if spec is SAT else "A"]


def test_reversion_is_kept_by_effectivity(spark):
    table = None
    for rows in ([(1, "A", day(1))], [(1, "B", day(2))], [(1, "A", day(3))]):
        existing = None if table is None else history.close_relationships(table, "hk_item")
        new = loads.load_eff_satellite(staged(spark, rows), EFF.link_hk, EFF.driving_hk, EFF.hub_hks, existing)
        table = new if table is None else table.unionByName(new)
    closed = history.close_relationships(table, "hk_item")
    periods = sorted((r.dss_start_date, r.dss_end_date, r.dss_is_active) for r in closed.collect())
    assert periods[:2] == [(day(1), day(2), "N"), (day(2), day(3), "N")]
    assert periods[2] == (day(3), None, "Y")


def test_two_targets_in_one_batch_then_again(spark):
    rows = [(1, "A", day(1)), (1, "B", day(2))]
    first = loads.load_eff_satellite(staged(spark, rows), EFF.link_hk, EFF.driving_hk, EFF.hub_hks)
    closed = history.close_relationships(first, "hk_item")
    assert sorted(r.dss_is_active for r in closed.collect()) == ["N", "Y"]
    again = loads.load_eff_satellite(staged(spark, rows), EFF.link_hk, EFF.driving_hk, EFF.hub_hks, closed)
    assert [r.dss_start_date for r in again.collect()] == [day(1)]


def test_driving_start_mode_compares_key_and_start(spark):
    args = (EFF.link_hk, EFF.driving_hk, EFF.hub_hks)
    first = loads.load_eff_satellite(staged(spark, [(1, "A", day(1)), (1, "A", day(1))]), *args, mode="driving_start")
    assert first.count() == 2
    new = loads.load_eff_satellite(staged(spark, [(1, "B", day(1)), (1, "A", day(2))]), *args, first, mode="driving_start")
    assert [r.dss_start_date for r in new.collect()] == [day(2)]


def test_link_needs_its_target_but_effectivity_does_not(spark):
    batch = staged(spark, [(1, None, day(1)), (2, "A", day(1))])
    assert loads.load_link(batch, LINK.link_hk, LINK.hub_hks, not_null=LINK.not_null).count() == 1
    assert loads.load_eff_satellite(batch, EFF.link_hk, EFF.driving_hk, EFF.hub_hks).count() == 2


def test_ties_at_the_last_load_date_stay_current(spark):
    closed = history.close_versions(sat_load(spark, [(1, "A", day(1)), (1, "B", day(1)), (2, "C", day(1))]), "hk_item")
    assert [v[2:] for v in versions(closed)] == [("Y", None)] * 3


def test_late_arrival_strict_and_recomputed(spark):
    on_time = history.close_versions(sat_load(spark, [(1, "A", day(1)), (1, "C", day(3))]), "hk_item")
    late = on_time.unionByName(sat_load(spark, [(1, "B", day(2))]))
    strict = history.close_open_only(late, "hk_item")
    assert versions(strict) == [("A", day(1), "N", day(3)), ("B", day(2), "N", day(3)), ("C", day(3), "Y", None)]
    assert history.interval_overlaps(strict, "hk_item").select("value").collect()[0].value == "A"
    repaired = history.close_versions(late, "hk_item")
    assert versions(repaired) == [("A", day(1), "N", day(2)), ("B", day(2), "N", day(3)), ("C", day(3), "Y", None)]
    assert history.interval_overlaps(repaired, "hk_item").count() == 0


def test_change_outside_the_diff_adds_no_version(spark):
    first = sat_load(spark, [(1, "A", day(1))])
    assert sat_load(spark, [(1, "A", day(2))], first).count() == 0


def test_subset_satellite_has_its_own_diff(spark):
    batch = staged(spark, [(1, "A", day(1)), (2, None, day(1))])
    where = F.col("value").isNotNull()
    sub = loads.load_subset_satellite(batch, "hk_item", "hd_item_ext", ["value"], where)
    assert sub.count() == 1 and "hd_item_ext" in sub.columns
    assert loads.load_subset_satellite(batch, "hk_item", "hd_item_ext", ["value"], where, sub).count() == 0


def test_rows_without_key_or_time_stay_open(spark):
    df = spark.createDataFrame(
        [(None, day(1)), (None, day(2)), ("k", None), ("k", day(1))], "hk string, dss_load_date timestamp_ntz"
    )
    assert {r.dss_is_current for r in history.close_versions(df, "hk").collect()} == {"Y"}


def test_as_of_is_half_open(spark):
    closed = history.close_versions(sat_load(spark, [(1, "A", day(1, 14)), (1, "B", day(3))]), "hk_item")
    assert history.as_of(closed, "2024-01-01 00:00:00").count() == 0
    assert [r.value for r in history.as_of(closed, "2024-01-02 23:59:59").collect()] == ["A"]
    assert [r.value for r in history.as_of(closed, "2024-01-03 00:00:00").collect()] == ["B"]
    key = closed.first().hk_item
    assert [r.value for r in history.history(closed, "hk_item", key).collect()] == ["B", "A"]


def test_ghosts_are_inserted_once(spark):
    sat = sat_load(spark, [(1, "A", day(1))]).withColumnRenamed("value", "name")
    once = ghosts.insert_ghosts(sat, "hk_item", "satellite", "hd_item")
    twice = ghosts.insert_ghosts(once, "hk_item", "satellite", "hd_item")
    assert twice.count() == 3
    ghost = twice.where(F.col("hk_item") == "0" * 64).first()
    assert (ghost.name, ghost.dss_is_current, ghost.dss_record_source, ghost.dss_load_date) == (
        "Unknown", "Y", "SYSTEM", datetime.datetime(1900, 1, 1),
    )
    hub = loads.load_hub(staged(spark, [(1, "A", day(1))]).withColumnRenamed("item_id", "object_id"), "hk_item", ["object_id"])
    keys = {r.object_id for r in ghosts.insert_ghosts(hub, "hk_item", "hub").collect()}
    assert keys == {1, -1, -2}


def test_evolve_keeps_history_and_rehashes(spark):
    table = history.close_versions(sat_load(spark, [(1, "A", day(1)), (1, "B", day(2))]), "hk_item")
    changed = evolve.evolve(table, "hd_item", ["value", "region"], add={"region": "string"}, sep="^^")
    assert changed.count() == 2 and changed.where("region is null").count() == 2
    expected = changed.select((F.col("hd_item") == hash_diff(changed, ["value", "region"], "^^")).alias("same"))
    assert {r.same for r in expected.collect()} == {True}
    with pytest.raises(ValueError):
        evolve.evolve(table, "hd_item", ["value"], rebuild=True)


@contextmanager
def setting(spark, name, value):
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def brute_force_next(rows):
    return {
        (k, ts): min((t for key, t in rows if key == k and t > ts), default=None) for k, ts in rows
    }


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 400_000)), min_size=1, max_size=60), st.booleans())
def test_next_later_equals_brute_force(spark, drawn, coalesced):
    """In one partition and in as many as there are."""
    rows = [(k, datetime.datetime(1969, 12, 30) + datetime.timedelta(seconds=s)) for k, s in drawn]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz")
    with setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", str(coalesced).lower()):
        found = {(r.k, r.ts): r.next_ts for r in history.next_later(df, "k", "ts").collect()}
    assert found == brute_force_next(rows)


def test_a_hot_key_is_closed_in_many_partitions(spark):
    """All of its times are in one second."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    hot = spark.range(20_000).select(F.lit("hot").alias("k"), (start + F.expr("make_dt_interval(0, 0, 0, id / 1000000)")).cast("timestamp_ntz").alias("ts"))
    cold = spark.range(10_000).select(F.col("id").cast("string").alias("k"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"))
    with setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"), setting(spark, "spark.sql.shuffle.partitions", "8"):
        found = history.next_later(hot.unionByName(cold), "k", "ts")
        assert found.where("k = 'hot' AND next_ts IS NULL").count() == 1
        assert found.where("k = 'hot'").agg(F.sum(F.expr("timestampdiff(MICROSECOND, ts, next_ts)"))).first()[0] == 19_999
        assert found.where("k <> 'hot' AND next_ts IS NOT NULL").count() == 0 and found.count() == 30_000
        placed = history.in_parts(hot.unionByName(cold).distinct(), "k", "ts")
        sizes = [r["count"] for r in placed.where("k = 'hot'").groupBy("_part").count().collect()]
    assert len(sizes) >= 5 and max(sizes) < 6000


def test_chained_pairs_are_not_shuffled_again(spark):
    df = spark.range(100).select((F.col("id") % 7).cast("string").alias("k"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"))
    later = history.next_later(df, "k", "ts")
    assert sum(r.next_ts is None for r in later.collect()) == 7
    plan = later._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") <= 1  # of the ends of partitions


def test_late_versions_are_chained_once(spark, tmp_path, monkeypatch):
    """Closing and looking for overlaps share the times that follow."""
    rows = [(i, datetime.datetime(2024, 1, 1 + i, 12), i % 2, "click" if i % 3 else "view", 1.0 * i, None) for i in range(29)]
    spark.createDataFrame(rows, fx.GIVEN["events"]).write.parquet(str(tmp_path / "events.parquet"))
    calls, chain = [], history.next_later
    monkeypatch.setattr(history, "next_later", lambda *args: calls.append(args) or chain(*args))
    found = {(r.dss_load_date.day, r.next_load_date.day) for r in queries.interval_overlaps(fx.Warehouse(spark, str(tmp_path))).collect()}
    assert found == {(14, 16), (15, 17)} and len(calls) == 2


def random_batches(seed, per_key_and_day=1):
    rng = random.Random(seed)
    return [
        [
            (key, rng.choice("ABC"), day(d, rng.randrange(24)))
            for key in range(6)
            if rng.random() < 0.7
            for _ in range(per_key_and_day)
        ]
        for d in range(1, 8)
    ]


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    """One vault loaded batch by batch, with everything in it."""
    batches = random_batches(5, per_key_and_day=3)
    spec = VaultSpec((HUB,), (LINK,), (SAT, LATEST), (EFF, EFF_START))
    vault = Vault(spark, str(tmp_path_factory.mktemp("vault")), spec, strict=True)
    vault.run([staged(spark, b) for b in batches])
    return vault, staged(spark, [r for b in batches for r in b]), batches


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    key = [tuple(map(str, r)) for r in a.select(*columns).collect()]
    assert sorted(key) == sorted(tuple(map(str, r)) for r in b.select(*columns).collect())


def test_replay_equals_batch_by_batch(spark, loaded):
    vault, feed, _ = loaded
    same(vault.rows("hub_item"), replay.replay_hub(feed, "batch", "hk_item", ["item_id"]))
    same(vault.rows("link_item_place"), replay.replay_link(feed, "batch", LINK.link_hk, LINK.hub_hks, not_null=LINK.not_null))
    same(vault.rows("sat_item"), replay.replay_satellite(feed, "batch", "hk_item", "hd_item", ["value"]))
    same(vault.rows("sat_item_latest"), replay.replay_satellite(feed, "batch", "hk_item", "hd_item", ["value"], "latest"))
    same(
        vault.rows("eff_sat_item_place"),
        replay.replay_eff_satellite(feed, "batch", EFF.link_hk, EFF.driving_hk, EFF.hub_hks),
    )


def test_in_order_state_equals_recomputation(spark, loaded):
    vault, _, _ = loaded
    for spec in (SAT, LATEST):
        same(vault.satellite_state(spec), vault.satellite(spec))
    assert history.interval_overlaps(vault.satellite(LATEST), "hk_item").count() == 0
    current = history.current(vault.satellite(LATEST)).groupBy("hk_item").count()
    assert current.count() == 6 and {r["count"] for r in current.collect()} <= {1, 2, 3}
    assert vault.eff_satellite(EFF).where("dss_is_active = 'Y'").select("hk_item").distinct().count() == 6


def test_repeating_a_load_changes_nothing(spark, loaded):
    vault, _, batches = loaded
    before = {t: vault.rows(t).count() for t in ("hub_item", "sat_item", "eff_sat_item_place")}
    vault.load(staged(spark, batches[-1]), len(batches) - 1)
    assert {t: vault.rows(t).count() for t in before} == before


def test_effectivity_loads_read_active_rows_only(spark, tmp_path, monkeypatch):
    """The history is read by the first load alone; loads run again give the same."""
    batches = [staged(spark, b).coalesce(1) for b in random_batches(9, per_key_and_day=2)[:4]]
    vault = Vault(spark, str(tmp_path / "vault"), VaultSpec(eff_satellites=(EFF,)))
    vault.load(batches[0], 0)
    rows = Vault.rows
    monkeypatch.setattr(Vault, "rows", None)
    for n, batch in enumerate(batches[1:], 1):
        vault.load(batch, n)
        assert vault.active(EFF).count() <= 2 * 6
    vault.load(batches[-1], len(batches) - 1)
    monkeypatch.setattr(Vault, "rows", rows)
    feed = staged(spark, [])
    for n, batch in enumerate(batches):
        feed = feed.unionByName(batch.withColumn("batch", F.date_add(F.lit("2024-01-01"), n)))
    expected = replay.replay_eff_satellite(feed, "batch", EFF.link_hk, EFF.driving_hk, EFF.hub_hks).cache()
    same(vault.rows(EFF.name), expected)
    same(vault.active(EFF), vault.eff_satellite(EFF).where("dss_is_active = 'Y'"))
    assert len(list((tmp_path / "vault" / f"{EFF.name}_active").iterdir())) == 2
    # A load from before the versions that are kept.
    vault.load(batches[1], 1)
    same(vault.rows(EFF.name), expected)


def test_entity_builds_loads_and_evolves(spark, tmp_path):
    entity = EntitySpec("item", ("item_id",), ("colour", "weight"), "shop", "2024-02-01 00:00:00", {"place": "place"})
    rows = spark.createDataFrame([(1, "red", 2.5, "A"), (2, None, 1.0, None)], "item_id bigint, colour string, weight double, place string")
    staged_rows = entity.stage(rows)
    assert {"hk_item", "hk_place", "hk_link_item_place", "hd_item"} <= set(staged_rows.columns)
    vault = Vault(spark, str(tmp_path), entity.vault())
    vault.run([staged_rows, entity.stage(rows.withColumn("colour", F.lit("blue")))])
    assert vault.rows("hub_item").count() == 2
    assert vault.rows("link_item_place").count() == 1
    assert vault.rows("sat_item").count() == 4
    changed = entity.evolve(add=["size"], drop=["weight"], diff_drop=["colour"], foreign_keys={"maker": "maker"})
    assert changed.staging().diffs["hd_item"].columns == ("size",)
    assert changed.vault().satellites[0].payload == ("colour", "size")
    assert [link.name for link in changed.vault().links] == ["link_item_place", "link_item_maker"]


def test_latest_compares_with_all_tied_versions(spark):
    batch = [(1, "A", day(1)), (1, "B", day(1))]
    first = sat_load(spark, batch, spec=LATEST)
    assert first.count() == 2
    assert sat_load(spark, batch, first, LATEST).count() == 0
    assert [r.value for r in sat_load(spark, [(1, "A", day(2)), (1, "C", day(2))], first, LATEST).collect()] == ["C"]


def test_replay_keeps_all_rows_of_a_batch(spark):
    feed = staged(spark, [(1, "A", day(1, 1)), (1, "B", day(1, 2)), (1, "C", day(2))])
    rows = replay.replay_satellite(feed, "batch", "hk_item", "hd_item", ["value"], "latest")
    assert sorted(r.value for r in rows.collect()) == ["A", "B", "C"]
    periods = replay.replay_eff_satellite(feed, "batch", EFF.link_hk, EFF.driving_hk, EFF.hub_hks)
    assert periods.count() == 3


def numbered(spark, rows):
    """Staged rows of (key, value, load date, batch)."""
    feed = staged(spark, [r[:3] for r in rows]).drop("batch").distinct()
    numbers = spark.createDataFrame(rows, "item_id bigint, value string, dss_load_date timestamp_ntz, batch int").distinct()
    joined = feed.join(numbers, ["item_id", "value", "dss_load_date"])
    return spark.createDataFrame(joined.collect(), joined.schema).coalesce(1)


def one_by_one(feed, load, rows):
    """What loads leave when each compares with all before it."""
    table = None
    for (batch,) in sorted(feed.select("batch").distinct().collect()):
        new = load(feed.where(F.col("batch") == batch), table)
        rows = new.collect() + ([] if table is None else table.collect())
        table = feed.sparkSession.createDataFrame(rows, new.schema).coalesce(1)
    return table


def replayed_and_loaded(spark, rows, busy):
    feed = numbered(spark, rows)

    def satellite(batch, before):
        return loads.load_satellite(batch, "hk_item", "hd_item", ["value"], before, "latest")

    def periods(batch, before):
        active = None if before is None else history.close_relationships(before, EFF.driving_hk)
        return loads.load_eff_satellite(batch, EFF.link_hk, EFF.driving_hk, EFF.hub_hks, active)

    same(one_by_one(feed, satellite, rows), replay.replay_satellite(feed, "batch", "hk_item", "hd_item", ["value"], "latest", busy))
    same(one_by_one(feed, periods, rows), replay.replay_eff_satellite(feed, "batch", EFF.link_hk, EFF.driving_hk, EFF.hub_hks, busy))


@pytest.mark.parametrize(("seed", "busy"), [(1, replay.BUSY), (2, 20)])
def test_replay_of_late_and_tied_rows_equals_the_loads(spark, seed, busy):
    """Load dates overlap, tie and repeat across batches; keys are followed in a
    stream, batch by batch, or some in one way and some in the other."""
    rng = random.Random(seed)
    rows = [(key, rng.choice("ABCDEF"), day(rng.randrange(1, 6)), rng.randrange(6)) for key in range(5) for _ in range(8 + 6 * key)]
    replayed_and_loaded(spark, rows, busy)


@pytest.mark.parametrize("busy", [0, replay.BUSY])
def test_values_known_at_one_date_over_several_batches(spark, busy):
    """Batch 4 begins with three values that three batches brought at one date."""
    rows = [(1, v, day(1), b) for b, v in enumerate("ABC", 1)]
    rows += [(1, v, day(d), 4) for v, d in zip("ABCD", (10, 9, 8, 7))] + [(1, "A", day(11), 5)]
    found = replay.replay_satellite(numbered(spark, rows), "batch", "hk_item", "hd_item", ["value"], "latest", busy)
    assert sorted((r.value, r.dss_load_date.day) for r in found.collect()) == [("A", 1), ("A", 11), ("B", 1), ("C", 1), ("D", 7)]


def test_many_batches_of_one_key_cost_the_same_each(spark):
    rows = [(1, "AB"[n % 2], day(1) + datetime.timedelta(minutes=n), n) for n in range(3000)]
    feed = numbered(spark, rows)
    assert replay.replay_satellite(feed, "batch", "hk_item", "hd_item", ["value"], "latest").count() == 3000


def test_rebuild_returns_open_versions(spark):
    rows = staged(spark, [(1, "A", day(1))]).select("hk_item", "hd_item", "dss_load_date", "dss_record_source", "value")
    rebuilt = evolve.evolve(rows, "hd_item", ["value"], staged=rows, rebuild=True, hk="hk_item")
    assert versions(rebuilt) == [("A", day(1), "Y", None)]
