"""Sources, sinks, views, logs, lineage, streams and plan shapes."""

import datetime
import decimal
import random

import pytest
from pyspark.sql import functions as F

from annalake.operators import history, lineage, loads, logs, marts, matching, quality, replay, staging
from annalake.plans import company as c
from annalake.plans import fixtures as fx
from annalake.plans.batches import Vault, VaultSpec
from annalake.plans.queries import USER_VAULT
from annalake.session import shared_dir
from annalake.sources import readers, schemas, sinks
from annalake.specs import SatelliteSpec
from annalake.streaming import state
from annalake.streaming.loads import feed_stream, stream_loads
from annalake.streaming.state import stream_keys, stream_versions


def test_appends_are_idempotent_per_load(spark, tmp_path):
    table = str(tmp_path / "t")
    assert sinks.read_appended(spark, table) is None
    sinks.write_append(spark.range(3), table, 0)
    sinks.write_append(spark.range(2), table, 1)
    sinks.write_append(spark.range(2), table, 1)
    assert sinks.read_appended(spark, table).count() == 5
    assert sinks.read_appended(spark, table, before=1).count() == 3
    assert sinks.read_appended(spark, table).columns == ["id"]


def test_folded_loads_are_seen_once(spark, tmp_path, monkeypatch):
    """Before, after and at every step between."""
    table, n = str(tmp_path / "t"), 16
    for load in range(n):
        sinks.write_append(spark.range(load, load + 1).coalesce(1), table, load)

    def check():
        for before in (None, 3, 9, 13):
            rows = sinks.read_appended(spark, table, before, spark.range(1).schema)
            assert sorted(r.id for r in rows.collect()) == list(range(n if before is None else before))
        assert sinks.read_appended(spark, table).columns == ["id"]
        assert sinks.read_appended(spark, table, 0) is None or sinks.read_appended(spark, table, 0).isEmpty()

    def names():
        return {p.name for p in tmp_path.joinpath("t").iterdir()}

    sinks.compact(spark, table, 3)
    assert len(names()) == n + 1
    check()
    # One dies before its folder is complete, the next before what it replaces is gone.
    sinks.compact(spark, table, 7)
    (tmp_path / "t" / "compacted=7" / "_SUCCESS").unlink()
    assert "compacted=3" in names() and "load_id=3" not in names() and "load_id=4" in names()
    check()
    with monkeypatch.context() as patch:
        act_on = sinks._file_system
        patch.setattr(sinks, "_file_system", lambda spark, path, act: None if act.__name__ == "<lambda>" else act_on(spark, path, act))
        sinks.compact(spark, table, 11)
    check()
    sinks.compact(spark, table, 14)
    check()
    assert names() == {"compacted=11", "compacted=14", *[f"load_id={k}" for k in range(12, 16)]}
    assert len(sinks.read_appended(spark, table).inputFiles()) <= 4
    with pytest.raises(ValueError):
        sinks.write_append(spark.range(1), table, 14)


def test_rebuilds_switch_only_when_complete(spark, tmp_path):
    table = str(tmp_path / "t")
    assert sinks.read_current(spark, table) is None
    assert sinks.write_overwrite(spark.range(3), table) == 0
    assert sinks.write_overwrite(sinks.read_current(spark, table).where("id > 0"), table) == 1
    spark.range(9).write.parquet(f"{table}/version=2")
    (tmp_path / "t" / "version=2" / "_SUCCESS").unlink()
    assert sinks.read_current(spark, table).count() == 2


def test_partitioned_rebuild(spark, tmp_path):
    table = str(tmp_path / "pit")
    df = spark.range(4).withColumn("snapshot_date", F.lit("2024-01-01"))
    sinks.write_overwrite(df, table, partition_by=["snapshot_date"])
    plan = sinks.read_current(spark, table).where("snapshot_date = '2024-01-01'")
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan._jdf.queryExecution().executedPlan().toString()


def test_seed_round_trip_with_quotes(spark, tmp_path):
    path = str(tmp_path / "seed")
    rows = [("CLIENT", 'say "hi", twice', "Kunde/Auftraggeber"), ("X", "a,b", "c")]
    readers.write_seed(spark.createDataFrame(rows, schemas.ROLE_SCHEMA), path)
    assert sorted(map(tuple, readers.read_seed(spark, path, schemas.ROLE_SCHEMA).collect())) == sorted(rows)


def test_declared_schema_and_pruned_scan(spark, tmp_path):
    path = str(tmp_path / "client")
    readers.conform(spark.range(1).select(F.col("id").alias("object_id")), schemas.CLIENT_SCHEMA).write.parquet(path)
    df = readers.read_source(spark, path, schemas.CLIENT_SCHEMA)
    plan = df.where("object_id = 3").select("name")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(object_id), EqualTo(object_id,3)]" in plan
    assert "ReadSchema: struct<object_id:bigint,name:string>" in plan


def test_union_keeps_fractions(spark):
    whole = spark.createDataFrame([(1, 2)], "object_id bigint, employeecount bigint")
    part = spark.createDataFrame([(2, 1.5)], "object_id bigint, employeecount double")
    rows = c.company_union([("CLIENT", whole), ("SUPPLIER", part)]).select("employeecount", "source_table").collect()
    assert [(str(r[0]), r[1]) for r in rows] == [
        ("2.000000000000000000", "wp_company_client"), ("1.500000000000000000", "wp_company_supplier"),
    ]


def test_two_byte_staging_leaves_the_role_key_alone(spark):
    feed = spark.createDataFrame([(1, "Firma")], "object_id bigint, name string")
    union = c.company_union([("CLIENT", feed)])
    narrow = staging.stage(union, c.company_spec("portal", fx.NOW)).first()
    wide = staging.stage(union, c.company_spec("portal", fx.NOW, encoding="UTF-16LE")).first()
    assert narrow.hk_role == wide.hk_role
    assert narrow.hk_company != wide.hk_company and narrow.hd_company != wide.hd_company


def test_views(spark, tmp_path):
    assert sinks.view_name(" mart_project ", "v") == "mart_project.v"
    assert sinks.view_name(None, "v", "dbo") == "dbo.v"
    sinks.publish_view(spark.range(2), "v_two")
    assert spark.table("v_two").count() == 2
    name = sinks.publish_sql_view(spark, "SELECT 1 AS one", "v_one", "mart_project")
    assert spark.table(name).first().one == 1
    sinks.drop_views(spark, ["v_two", name, "nowhere.v_gone", "v_gone"])
    assert not spark.catalog.tableExists("v_two")


def test_bucketed_tables_join_without_a_shuffle(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("hk_x"), "id")
    for name in ("hub_b", "sat_b"):
        sinks.write_bucketed(rows, name, "hk_x", 4)
    joined = spark.table("hub_b").hint("merge").join(spark.table("sat_b"), "hk_x")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 100


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1, 1), (2, "b", 1, 1)], "k int, v string, created_at int, updated_at int")
    new = spark.createDataFrame([(2, "x", 5, 5), (2, "y", 6, 6), (3, "z", 7, 7)], old.schema)
    rows = {r.k: (r.v, r.created_at, r.updated_at) for r in logs.upsert(old, new, ["k"]).collect()}
    assert rows == {1: ("a", 1, 1), 2: ("y", 1, 6), 3: ("z", 7, 7)}


def test_recent_per_key_ranks_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    recent = logs.recent_per_key(df, "k", [F.col("id").desc()], 2)
    assert recent.count() == 6
    assert recent._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2


def test_latest_status(spark):
    runs = spark.createDataFrame(
        [("a", "success", 1), ("a", "fail", 2), ("b", "error", 1), ("b", "success", 2), ("c", "skipped", 3), ("c", "success", 1)],
        "model string, status string, at int",
    )
    models = spark.createDataFrame([("a",), ("d",)], "model string")
    found = {r.model: r.state for r in logs.latest_status(runs, models, "model", "status", ["at"]).collect()}
    assert found == {"a": "failed", "b": "deployed", "c": "deployed", "d": "pending"}


def test_reachable_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    down = {r.node: r.distance for r in lineage.reachable(edges, seeds).collect()}
    assert down == {"b": 1, "c": 2, "d": 3}
    up = {r.node: r.distance for r in lineage.reachable(edges, spark.createDataFrame([("d",)], "node string"), "up").collect()}
    assert up == {"c": 1, "b": 2, "a": 3}
    assert lineage.reachable(edges, seeds, max_rounds=1).count() == 1
    assert [r.node for r in lineage.direct_neighbours(edges, "a", "up").collect()] == ["c"]
    with pytest.raises(ValueError):
        lineage.direct_neighbours(edges, "a", "sideways")


def test_shared_folder_is_the_named_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def event(i, user, kind, at):
    return (i, at, user, kind, 1.0, "{}")


EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def test_stream_of_files_equals_batch_loads(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    kinds = ["view", "click", "view", "view", "error", "click"]
    files = [[event(d * 10 + u, u, kinds[(d + u) % 6], start + datetime.timedelta(days=d, hours=u)) for u in range(4)] for d in range(4)]
    source = tmp_path / "in"
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    vault = Vault(spark, str(tmp_path / "vault"), USER_VAULT)
    schema = spark.createDataFrame(files[0], EVENT_SCHEMA).schema
    feed = feed_stream(spark, str(source), schema, files_per_batch=1)
    stream_loads(feed, fx.event_feed, vault, str(tmp_path / "progress")).awaitTermination()
    once = Vault(spark, str(tmp_path / "once"), USER_VAULT)
    once.run([fx.event_feed(spark.createDataFrame(rows, EVENT_SCHEMA)) for rows in files])
    sat = USER_VAULT.satellites[0]
    a, b = vault.satellite(sat), once.satellite(sat)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0
    # Nothing new: a restart loads nothing.
    stream_loads(feed, fx.event_feed, vault, str(tmp_path / "progress")).awaitTermination()
    assert vault.satellite(sat).count() == b.count()


def as_text(df):
    return sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("compare", ["any", "latest"])
def test_state_store_equals_loads_and_reads_none_of_them(spark, tmp_path, monkeypatch, compare):
    """Load dates tie and come late; payloads have NULLs, NaN, quotes and microseconds."""
    rng = random.Random(3)
    kind = "item_code string, hk_item string, hd_item string, dss_load_date timestamp_ntz, dss_record_source string, n int, price decimal(38,18), ratio double, at timestamp_ntz, label string"
    spec = SatelliteSpec("sat_item", "hk_item", "hd_item", ("n", "price", "ratio", "at", "label"), compare)

    def batch(_):
        rows = []
        for _ in range(12):
            diff = rng.choice("ABCD")
            when = None if rng.random() < 0.1 else datetime.datetime(2024, 1, rng.randrange(1, 5))
            ratio = rng.choice([0.1, float("nan"), None, 1e300])
            price = rng.choice([None, decimal.Decimal("0.000000000000000001")])
            rows.append((None, rng.choice(["k1", "k2", "k3", None]), diff, when, "test", rng.choice([None, 1]), price, ratio, datetime.datetime(2024, 1, 1, 0, 0, 0, 123456), rng.choice(['a "b"\n', "", None])))
        return rows

    batches = [batch(n) for n in range(5)]
    vault = Vault(spark, str(tmp_path / "vault"), VaultSpec(satellites=(spec,)))
    vault.run([spark.createDataFrame(rows, kind) for rows in batches])
    expected = as_text(vault.rows("sat_item"))

    source, table, progress = (str(tmp_path / n) for n in ("in", "table", "progress"))
    schema = spark.createDataFrame(batches[0], kind).schema
    monkeypatch.setattr(sinks, "read_appended", None)
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        # A new query each time: everything it knows is in the checkpoint.
        stream_versions(feed_stream(spark, source, schema), spec, table, progress).awaitTermination()
    monkeypatch.undo()
    assert as_text(sinks.read_appended(spark, table)) == expected


def test_hub_from_the_state_store(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "hub")
    kind = "item_code string, hk_item string, dss_load_date timestamp_ntz, dss_record_source string"
    first, second = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2)
    for rows in ([("1", "a", first, "x"), ("1", "a", first, "x"), ("1", "a", second, "x"), (None, None, first, "x")], [("1", "a", second, "y"), ("2", "b", second, "y")]):
        df = spark.createDataFrame(rows, kind)
        df.coalesce(1).write.mode("append").parquet(source)
        stream_keys(feed_stream(spark, source, df.schema), ["hk_item"], ["item_code"], table, str(tmp_path / "progress")).awaitTermination()
    found = sorted((r.hk_item, r.dss_load_date, r.dss_record_source) for r in sinks.read_appended(spark, table).collect())
    assert found == [("a", first, "x"), ("a", second, "x"), ("b", second, "y")]


def test_states_are_shared_by_keys(spark, tmp_path, monkeypatch):
    """Many keys in few states, so that Python isn't called for each of them."""
    monkeypatch.setattr(state, "BUCKETS", 3)
    source, table, progress = (str(tmp_path / n) for n in ("in", "table", "progress"))
    kind = "hk_item string, hd_item string, dss_load_date timestamp_ntz, dss_record_source string, n int"
    spec, at = SatelliteSpec("sat_item", "hk_item", "hd_item", ("n",)), datetime.datetime(2024, 1, 1)
    for n, keys in enumerate((range(40), range(20, 60))):
        df = spark.createDataFrame([(f"k{k}", "d", at, "x", n) for k in keys for _ in range(2)], kind)
        df.coalesce(1).write.mode("append").parquet(source)
        query = stream_versions(feed_stream(spark, source, df.schema), spec, table, progress)
        query.awaitTermination()
        assert [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]] == [3]
    found = sorted((r.hk_item, r.n) for r in sinks.read_appended(spark, table).collect())
    assert found == sorted((f"k{k}", int(k >= 40)) for k in range(60) for _ in range(2))


def test_folding_does_not_shuffle(spark, tmp_path):
    table = str(tmp_path / "t")
    for load in range(3):
        sinks.write_append(spark.range(load, load + 1), table, load)
    sinks.compact(spark, table, 1)
    rows = sinks._folding(spark, table, [2], 1)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in rows.collect()) == [(0, 0), (1, 1), (2, 2)]


def test_periods_are_shuffled_once(spark):
    """Folded where the anti-join has put them, twice staged rows come once."""
    at = datetime.datetime(2024, 1, 1)
    kind = "hk_link string, hk_a string, hk_b string, dss_load_date timestamp_ntz, dss_record_source string"
    rows = spark.createDataFrame([(f"l{i % 9}", f"a{i % 9}", "b", at, "x") for i in range(18)], kind)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        old = loads.load_eff_satellite(rows.where("hk_link = 'l0'"), "hk_link", "hk_a", ["hk_a", "hk_b"])
        new = loads.load_eff_satellite(rows, "hk_link", "hk_a", ["hk_a", "hk_b"], old)
        assert sorted(r.hk_link for r in new.collect()) == [f"l{i}" for i in range(1, 9)]
        plan = new._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("LeftAnti")[0]
        assert "Aggregate" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_old_versions_are_dropped(spark, tmp_path):
    table = str(tmp_path / "t")
    for n in range(5):
        sinks.write_overwrite(spark.range(n + 1), table)
    (tmp_path / "t" / "version=1").joinpath("_SUCCESS").unlink()
    sinks.drop_versions(spark, table)
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["version=3", "version=4"]
    assert sinks.read_current(spark, table).count() == 5
    sinks.drop_versions(spark, str(tmp_path / "none"))


@pytest.fixture
def small_skew_limits(spark):
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.shuffle.partitions": "64",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_rows(spark):
    """A third of the rows share one key, and most of those one load date."""
    hot = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 5000))
    load = F.when(F.col("id") % 6 == 0, F.lit(0)).otherwise(F.col("id") % 400) * F.lit(3600)
    return spark.range(60_000, numPartitions=8).select(
        hot.alias("hk"), F.timestamp_seconds(load).cast("timestamp_ntz").alias("dss_load_date"), F.sha2(F.col("id").cast("string"), 256).alias("v")
    )


def test_hot_key_is_split_when_versions_are_closed(spark, small_skew_limits):
    rows = hot_rows(spark)
    closed = history.close_versions(rows, "hk")
    assert closed.count() == 60_000
    result = closed.where("hk = 'hot'").groupBy("dss_load_date").agg(F.min("dss_end_date").alias("e"), F.max("dss_end_date").alias("f")).collect()
    times = sorted({r.dss_load_date for r in result})
    following = dict(zip(times, times[1:] + [None]))
    assert all(r.e == r.f == following[r.dss_load_date] for r in result)
    df = history.close_versions(rows, "hk")
    df.collect()
    assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_hot_key_is_split_in_the_anti_join(spark, small_skew_limits):
    # One diff for the hot key: a group of copies holding a third of the rows.
    same = F.when(F.col("hk") == "hot", F.lit("same")).otherwise(F.col("v"))
    staged = hot_rows(spark).withColumn("hd", same).withColumn("dss_record_source", F.lit("t"))
    new = loads.load_satellite(staged, "hk", "hd", ["v"], staged.where("hk <> 'hot'"))
    assert len(new.collect()) == 20_000
    assert "skew=true" in new._jdf.queryExecution().executedPlan().toString()


def test_hot_key_is_split_in_checks_and_walks(spark, small_skew_limits):
    rows = hot_rows(spark)
    hub = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("hk"))
    lost = quality.orphans(rows, hub, "hk")
    assert len(lost.collect()) == 20_000
    assert "skew=true" in lost._jdf.queryExecution().executedPlan().toString()
    edges = rows.select(F.col("hk").alias("_from"), F.col("v").alias("node"))
    frontier = spark.range(3).select(F.when(F.col("id") == 0, "hot").otherwise("none").alias("_from"))
    step = matching.present_in(edges, frontier, ["_from"])
    assert len(step.collect()) == 20_000
    assert "skew=true" in step._jdf.queryExecution().executedPlan().toString()


def test_hot_key_is_split_in_marts(spark, small_skew_limits):
    links = hot_rows(spark).select("hk", F.col("v").alias("hk_target"))
    hub = spark.range(5200).select(F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("hk"), F.lit(1).alias("object_id"))
    hub = hub.withColumn("dss_load_date", F.lit("2024-01-01").cast("timestamp_ntz"))
    sat = hub.select("hk", F.col("hk").alias("name"), F.lit("Y").alias("dss_is_current"))
    target = spark.range(10).select(F.sha2(F.col("id").cast("string"), 256).alias("hk_target"), F.col("id").alias("label"), F.lit("Y").alias("dss_is_current"))

    def view(many):
        shown = marts.SatelliteSource("sat_target", target)
        return marts.mart(hub, "hk", [marts.SatelliteSource("sat_x", sat)], [marts.LinkSource("link_x", links, "hk_target", shown, many)])

    split, plain = view(True), view(False)
    counts = [{r.hk: (r.n, r.labels) for r in v.groupBy("hk").agg(F.count("*").alias("n"), F.count("label").alias("labels")).collect()} for v in (split, plain)]
    assert counts[0] == counts[1] and counts[0]["hot"][0] == 20_000 and counts[0]["k5100"] == (1, 0)
    split.collect()
    assert "skew=true" in split._jdf.queryExecution().executedPlan().toString()


def test_long_walks_merge_their_frontiers(spark, monkeypatch):
    monkeypatch.setattr(lineage, "MERGE_ROUNDS", 3)
    chain = spark.range(9).select(F.col("id").cast("string").alias("src"), (F.col("id") + 1).cast("string").alias("dst"))
    found = {r.node: r.distance for r in lineage.reachable(chain, spark.sql("SELECT '0' AS node")).collect()}
    assert found == {str(i): i for i in range(1, 10)}


def test_hot_key_is_split_in_replays(spark, small_skew_limits):
    feed = hot_rows(spark).select(
        "hk", F.when(F.col("hk") == "hot", "same").otherwise(F.col("v")).alias("hd"), "v", "dss_load_date",
        F.lit("t").alias("dss_record_source"), F.to_date("dss_load_date").alias("batch"),
    )
    table = replay.replay_satellite(feed, "batch", "hk", "hd", ["v"])
    rows = table.collect()
    first = feed.where("hk = 'hot'").agg(F.min("batch")).first()[0]
    assert sum(r.hk == "hot" for r in rows) == feed.where((F.col("hk") == "hot") & (F.col("batch") == first)).count()
    assert sum(r.hk != "hot" for r in rows) == 40_000
    assert "skew=true" in table._jdf.queryExecution().executedPlan().toString()
