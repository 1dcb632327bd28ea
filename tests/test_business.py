"""Point-in-time tables, bridges, marts and checks."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from annalake.operators import history, marts, pit, quality
from annalake.operators.marts import LinkSource, SatelliteSource
from annalake.operators.quality import Check
from annalake.plans import company as c
from annalake.plans import fixtures as fx


def ts(text):
    return datetime.datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def sat(spark):
    rows = [
        ("a", ts("2024-01-01 14:30"), "A1"),
        ("a", ts("2024-01-01 18:00"), "A2"),
        ("a", ts("2024-01-05 00:00"), "A3"),
        ("b", ts("2024-01-03 09:00"), "B1"),
    ]
    return spark.createDataFrame(rows, "hk_x string, dss_load_date timestamp_ntz, value string")


@pytest.fixture(scope="module")
def hub(spark):
    return spark.createDataFrame(
        [("a", 1), ("b", 2), ("c", 3), ("z", -1)], "hk_x string, object_id bigint"
    ).selectExpr("*", "timestamp_ntz'2024-01-01' dss_load_date", "'t' dss_record_source")


def days(df):
    return sorted((r[0], str(r.snapshot_date), str(r[-1])) for r in df.collect())


def test_pit_covers_days_from_the_first_version_on(spark, hub, sat):
    table = pit.pit(hub, sat, "hk_x", "sat_x", "2024-02-01 00:00:00")
    found = sorted((r.hk_x, str(r.snapshot_date), str(r.sat_x_load_date)) for r in table.collect())
    assert found == [
        ("a", "2024-01-01", "2024-01-01 18:00:00"),
        ("a", "2024-01-03", "2024-01-01 18:00:00"),
        ("a", "2024-01-05", "2024-01-05 00:00:00"),
        ("b", "2024-01-03", "2024-01-03 09:00:00"),
        ("b", "2024-01-05", "2024-01-03 09:00:00"),
    ]
    row = table.first()
    assert row.sat_x_hk == row.hk_x and row.dss_record_source == "PIT_GENERATION"


def test_pit_with_its_own_snapshot_days(spark, hub, sat):
    spine = spark.sql("SELECT explode(array(date'2023-12-31', date'2024-01-02', date'2024-01-31')) AS snapshot_date")
    table = pit.pit(hub, sat, "hk_x", "sat_x", "2024-02-01 00:00:00", spine=spine)
    assert sorted((r.hk_x, str(r.snapshot_date)) for r in table.collect()) == [
        ("a", "2024-01-02"), ("a", "2024-01-31"), ("b", "2024-01-31"),
    ]


@pytest.mark.parametrize("own_days", [False, True])
def test_pit_equals_the_naive_lookup(spark, own_days):
    rng = random.Random(8)
    start = datetime.datetime(2024, 1, 1)
    versions = [
        (f"k{k}", start + datetime.timedelta(days=rng.randrange(300), hours=rng.randrange(24)))
        for k in range(30)
        for _ in range(rng.randrange(6))
    ]
    days = {v.date() for _, v in versions}
    if own_days:
        days = {start.date() + datetime.timedelta(days=rng.randrange(-20, 340)) for _ in range(120)}
    expected = set()
    for key in {k for k, _ in versions}:
        for d in days:
            seen = [v for k, v in versions if k == key and v.date() <= d]
            if seen:
                expected.add((key, str(d), str(max(seen))))
    sat = spark.createDataFrame(versions, "hk_x string, dss_load_date timestamp_ntz")
    hub = sat.select("hk_x")
    spine = spark.createDataFrame([(d,) for d in days], "snapshot_date date") if own_days else None
    table = pit.pit(hub, sat, "hk_x", "sat_x", "2024-02-01 00:00:00", spine=spine)
    rows = [(r.hk_x, str(r.snapshot_date), str(r.sat_x_load_date)) for r in table.collect()]
    assert len(rows) == len(expected) and set(rows) == expected


def test_pit_leaves_out_keys_the_hub_does_not_have(spark, hub, sat):
    table = pit.pit(hub.where("hk_x = 'b'"), sat, "hk_x", "sat_x", "2024-02-01 00:00:00")
    assert {r.hk_x for r in table.collect()} == {"b"}


def test_pit_multi_keeps_rows_any_satellite_covers(spark, hub, sat):
    other = spark.createDataFrame([("c", ts("2024-01-03 00:00"))], "hk_x string, dss_load_date timestamp_ntz")
    table = pit.pit_multi(hub, {"sat_x": sat, "sat_y": other}, "hk_x")
    rows = {(r.hk_x, str(r.snapshot_date)): r for r in table.collect()}
    assert len(rows) == 5 + 2
    assert rows["c", "2024-01-05"].sat_x_hk is None and rows["c", "2024-01-05"].sat_y_hk == "c"
    assert rows["a", "2024-01-03"].sat_y_ldts is None


def test_pit_has_no_nested_loops_and_lookup_hits_one_version(spark, hub, sat):
    table = pit.pit(hub, sat, "hk_x", "sat_x", "2024-02-01 00:00:00")
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    found = pit.pit_lookup(table, sat, "hk_x", "2024-01-03", "sat_x_load_date")
    assert sorted((r.hk_x, r.value) for r in found.collect()) == [("a", "A2"), ("b", "B1")]


def test_pit_sees_the_load_day_the_direct_question_does_not(spark, hub, sat):
    table = pit.pit(hub, sat, "hk_x", "sat_x", "2024-02-01 00:00:00")
    assert pit.pit_lookup(table, sat, "hk_x", "2024-01-01", "sat_x_load_date").count() == 1
    closed = history.close_versions(sat, "hk_x")
    assert history.as_of(closed, "2024-01-01 00:00:00").count() == 0


def test_bridge_combines_links_of_the_anchor(spark, hub):
    one = spark.createDataFrame([("a", "l1", "p"), ("a", "l2", "q")], "hk_x string, hk_link_x_p string, hk_p string")
    two = spark.createDataFrame([("a", "m1", "r"), ("b", "m2", "r")], "hk_x string, hk_link_x_r string, hk_r string")
    rows = pit.bridge(hub, "hk_x", [(one, "hk_link_x_p", ["hk_p"]), (two, "hk_link_x_r", ["hk_r"])])
    assert rows.columns[:5] == ["hk_x", "hk_p", "hk_r", "hk_link_x_p", "hk_link_x_r"]
    assert sorted((r.hk_x, r.hk_p, r.hk_r) for r in rows.collect()) == [("a", "p", "r"), ("a", "q", "r")]


def test_alias_rule():
    requests = [("sat_company", "name"), ("sat_country", "name"), ("eff_sat_country", "name"), ("sat_a", "object_id")]
    assert marts.unique_aliases(requests, ["object_id"]) == ["name", "country_name", "country_name2", "a_object_id"]


def test_mart_ghosts_stars_and_link_fan_out(spark, hub):
    sat = spark.createDataFrame(
        [("a", "new", "Y", "h"), ("a", "old", "N", "h"), ("b", "bee", "Y", "h")],
        "hk_x string, name string, dss_is_current string, hd_x string",
    )
    link = spark.createDataFrame([("a", "p"), ("a", "q")], "hk_x string, hk_place string")
    place = spark.createDataFrame([("p", "P", "Y"), ("q", "Q", "Y")], "hk_place string, name string, dss_is_current string")
    view = marts.mart(
        hub, "hk_x", [SatelliteSource("sat_x", sat)], [LinkSource("link_x_place", link, "hk_place", SatelliteSource("sat_place", place))]
    )
    assert view.columns == ["hk_x", "object_id", "name", "place_name", "hub_load_date"]
    assert sorted((r.hk_x, r.name, r.place_name) for r in view.collect() if r.name) == [
        ("a", "new", "P"), ("a", "new", "Q"), ("b", "bee", None),
    ]
    assert "z" not in {r.hk_x for r in view.collect()}
    everything = marts.mart(hub, "hk_x", [SatelliteSource("sat_x", sat, current_only=False)], exclude_ghosts=False)
    assert everything.count() == 5
    top = marts.top_n(view, [view["object_id"].desc()], 1, "hk_x")
    assert [r.hk_x for r in top.collect()] == ["c"]
    assert "TakeOrdered" in top._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in marts.in_target(sat, link, place, "hk_x", "hk_place", "Q", "place").collect()] == [("new", "Q")]


def test_satellite_under_another_parent_key(spark, hub):
    sat = spark.createDataFrame([("a", 5, "Y")], "hk_parent string, amount int, dss_is_current string")
    view = marts.mart(hub, "hk_x", [SatelliteSource("sat_x_ext", sat, hk="hk_parent")])
    assert {r.hk_x: r.amount for r in view.collect()}["a"] == 5


def test_checks_count_what_they_say(spark):
    child = spark.createDataFrame(
        [("k1", "A"), ("k1", "B"), ("k2", "X"), (None, "Y"), ("k9", None), ("k9", "X")], "k string, v string"
    )
    parent = spark.createDataFrame([("k1",), ("k2",)], "k string")
    suite = [
        Check("child", "k", "not_null"),
        Check("child", "v", "accepted_values", ("A", "B")),
        Check("child", "k", "unique"),
        Check("child", "k", "relationships", parent="parent", field="k"),
        Check("parent", "k", "unique"),
    ]
    found = quality.run_checks({"child": child, "parent": parent}, suite)
    assert {(r.model, r.column_name, r.test): r.failures for r in found.collect()} == {
        ("child", "k", "not_null"): 1,
        ("child", "v", "accepted_values"): 2,
        ("child", "k", "unique"): 2,
        ("child", "k", "relationships"): 2,
        ("parent", "k", "unique"): 0,
    }
    assert quality.orphans(child, parent, "k").count() == 3
    assert quality.not_null(child, "v").count() == 1
    assert quality.accepted_values(child, "v", ("A", "B")).count() == 2
    with pytest.raises(ValueError):
        quality.run_checks({"child": child}, [Check("child", "k", "regex")]).count()


def test_reconciliation(spark):
    a, b = spark.range(5), spark.range(3)
    row = quality.load_reconciliation([("layer", a, b)]).first()
    assert (row.source_rows, row.vault_rows, row.difference) == (5, 3, -2)
    assert quality.table_stats({"a": a}).first().n_rows == 5


def test_refreshed_point_in_time_equals_a_rebuild(spark, tmp_path):
    """Days come in order, several at once, late, and twice; later days alone are read and written."""
    rng = random.Random(8)
    start = datetime.datetime(2024, 1, 1)
    rows = [(f"k{rng.randrange(6)}", start + datetime.timedelta(days=rng.randrange(20), hours=rng.randrange(24))) for _ in range(60)]
    sat = spark.createDataFrame(rows, "hk_item string, dss_load_date timestamp_ntz").coalesce(1)
    hub = spark.createDataFrame([(f"k{n}",) for n in range(5)], "hk_item string").coalesce(1)
    table, late = str(tmp_path / "pit"), F.to_date("dss_load_date") == F.lit("2024-01-04").cast("date")

    def refresh(known, changed_from):
        pit.refresh_pit(table, hub, known, "hk_item", "sat_item", "2024-02-01 00:00:00", changed_from)
        columns = ["hk_item", "snapshot_date", "sat_item_load_date"]
        found = pit.stored_pit(spark, table).select(*columns).collect()
        expected = pit.pit(hub, known, "hk_item", "sat_item", "2024-02-01 00:00:00").select(*columns).collect()
        assert sorted(map(tuple, found)) == sorted(map(tuple, expected))

    def files():
        return {p: p.stat().st_mtime_ns for p in (tmp_path / "pit").rglob("*.parquet")}

    on_time = sat.where(~late)
    refresh(on_time.where("dss_load_date < '2024-01-08'"), None)
    before = files()
    refresh(on_time.where("dss_load_date < '2024-01-12'"), datetime.date(2024, 1, 8))
    refresh(on_time.where("dss_load_date < '2024-01-12'"), datetime.date(2024, 1, 8))
    assert before.items() <= files().items()
    refresh(on_time, datetime.date(2024, 1, 12))
    refresh(sat, datetime.date(2024, 1, 4))
    assert {p for p in before if p.parent.name < "snapshot_date=2024-01-04"} <= set(files())


def test_every_table_of_a_suite_is_scanned_once(spark, tmp_path):
    """Six checks on three tables, two of them parents."""
    rows = {"hub": [("a", 1), ("b", 1), (None, 3)], "sat": [("a", 1), ("a", 2), ("c", None), ("d", 9), ("d", 9)], "ref": [("x", 1)]}
    tables = {}
    for name, values in rows.items():
        spark.createDataFrame(values, "hk string, n int").coalesce(1).write.parquet(str(tmp_path / name))
        tables[name] = spark.read.parquet(str(tmp_path / name))
    checks = [
        Check("hub", "hk", "not_null"),
        Check("hub", "n", "unique"),
        Check("sat", "hk", "relationships", parent="hub", field="hk"),
        Check("sat", "n", "relationships", parent="ref", field="n"),
        Check("sat", "hk", "accepted_values", ("a",)),
        Check("ref", "hk", "unique"),
    ]
    found = quality.run_checks(tables, checks)
    assert {(r.model, r.column_name, r.test): r.failures for r in found.collect()} == {
        ("hub", "hk", "not_null"): 1,
        ("hub", "n", "unique"): 1,
        ("sat", "hk", "relationships"): 3,
        ("sat", "n", "relationships"): 3,
        ("sat", "hk", "accepted_values"): 2,
        ("ref", "hk", "unique"): 0,
    }
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3
    with pytest.raises(ValueError):
        quality.run_checks(tables, [Check("hub", "hk", "between")])


def test_a_parent_key_travels_once(spark):
    """However many checks look at it, and as no more than 32 bytes."""
    hub = spark.range(5).select(F.sha2(F.col("id").cast("string"), 256).alias("hk"))
    sat = hub.limit(3).unionByName(spark.createDataFrame([("lost" * 20,), ("lost",)], "hk string"))
    checks = [Check("hub", "hk", "unique"), *[Check(m, "hk", "relationships", parent="hub", field="hk") for m in ("sat", "link")]]
    places = quality._groups(checks)
    records = quality._records(hub, "hub", checks, places, 3).collect()
    assert len(records) == 5 and {len(r.value) for r in records} == {32}
    found = quality.run_checks({"hub": hub, "sat": sat, "link": sat}, checks).collect()
    assert sorted((r.model, r.failures) for r in found) == [("hub", 0), ("link", 2), ("sat", 2)]


def test_marts_over_buckets_exchange_nothing_by_company(spark):
    """The links of a company stay in its bucket as well."""
    w = fx.Warehouse(spark, "/root/testdata/sf0.001")
    w = w.bucketed(hub_company="hk_company", sat_company="hk_company", link_country="hk_company", link_role="hk_company", sat_country="hk_country")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for mart in (
            c.company_current(w.hub_company, w.sat_company),
            c.company_extended(w.hub_company, w.sat_company, w.link_country, w.sat_country),
            c.company_full(w.hub_company, w.sat_company, w.link_role, w.roles, w.link_country, w.sat_country),
        ):
            plan = mart._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(hk_company" not in plan and "SortMergeJoin [hk_company" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
