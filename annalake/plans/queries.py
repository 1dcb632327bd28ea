"""Every operator as a query over the given tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalake.functions import hashing, markup, vectors
from annalake.operators import (
    corpus,
    evolve,
    ghosts,
    history,
    lineage,
    loads,
    logs,
    marts,
    pit,
    quality,
    replay,
    similarity,
    staging,
)
from annalake.plans import company as c
from annalake.plans import fixtures as fx
from annalake.plans.batches import Vault, VaultSpec
from annalake.plans.entity import EntitySpec
from annalake.session import tune
from annalake.sources import readers, sinks
from annalake.specs import END_DATE, IS_CURRENT, LOAD_DATE, RECORD_SOURCE, START_DATE
from annalake.specs import EffSatelliteSpec, HubSpec, SatelliteSpec
from annalake.streaming.loads import feed_stream, stream_loads
from annalake.streaming.state import stream_versions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Moments the as-of questions ask about.
MOMENT = "2024-01-15 12:00:00"
SNAPSHOT = "2024-01-15"
HALF_TIME = "2024-01-16"


def comparable(df: DataFrame) -> DataFrame:
    """Days as text and decimals as doubles, so that any client reads them alike."""
    shown = []
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(f.dataType, T.DecimalType):
            column = column.cast("double")
        shown.append(column.alias(f.name))
    return df.select(*shown)


def query(function: Callable[[fx.Warehouse], DataFrame], direct: bool = False) -> Callable[[fx.Warehouse], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(function(fx.Warehouse(tune(spark), sf_dir, direct=direct)))

    QUERIES[function.__name__] = run
    return function


# Queries that read the staged rows once need no stored copy of them.
query_in_place = partial(query, direct=True)


# -- staging -------------------------------------------------------------------


@query
def stage_company(w: fx.Warehouse) -> DataFrame:
    return w.staged_view


@query
def stage_country(w: fx.Warehouse) -> DataFrame:
    return w.staged_country


@query
def stage_project(w: fx.Warehouse) -> DataFrame:
    return w.staged_project


@query
def hash_key_md5(w: fx.Warehouse) -> DataFrame:
    df = w.table("customer")
    both = ["c_custkey", "c_mktsegment"]
    return df.select(
        "c_custkey",
        hashing.hash_key(df, both, sep=hashing.MACRO_SEPARATOR, algorithm="MD5").alias("hk_md5"),
        hashing.hash_key(df, both, sep=hashing.MACRO_SEPARATOR).alias("hk_sha"),
        hashing.fk_hash_key(df, "c_nationkey").alias("hk_country"),
        hashing.link_hash_key(df, ["c_custkey"], ["c_nationkey"]).alias("hk_link"),
    )


@query
def hash_key_utf16(w: fx.Warehouse) -> DataFrame:
    df = w.table("customer")
    return df.select("c_custkey", hashing.hash_key(df, ["c_custkey", "c_name"], encoding="UTF-16LE").alias("hk_company"))


@query
def hash_diff_nosep(w: fx.Warehouse) -> DataFrame:
    df = w.table("orders")
    columns = ["o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    return df.select(
        "o_orderkey",
        hashing.hash_diff(df, columns).alias("hd_plain"),
        hashing.hash_diff(df, columns, sep="^^").alias("hd_separated"),
    )


@query
def union_feeds(w: fx.Warehouse) -> DataFrame:
    customer = w.table("customer")
    feeds = [
        ("CONTRACTOR", fx.contractor_feed(customer)),
        ("SUPPLIER", fx.supplier_feed(w.table("supplier"))),
    ]
    shown = ("object_id", "role_code", "source_table", "name", "country", "credit_rating", "subscription")
    return c.company_union(feeds).select(*shown, F.col("employeecount").cast("string").alias("employeecount"))


@query
def derived_columns(w: fx.Warehouse) -> DataFrame:
    definitions = {"record_source": "!crm", "segment_code": "lower(substring(c_mktsegment, 1, 3))"}
    return staging.derived_columns(w.table("customer"), definitions).select("c_custkey", "record_source", "segment_code")


@query
def seed_reference(w: fx.Warehouse) -> DataFrame:
    """The regions as a CSV reference table, written and read back."""
    regions = w.table("region").select(F.col("r_regionkey").cast("string").alias("region_code"), F.col("r_name").alias("region_name"))
    path = f"{w.folder}/ref_region"
    readers.write_seed(regions, path)
    return readers.read_seed(w.spark, path, regions.schema)


@query
def load_metadata(w: fx.Warehouse) -> DataFrame:
    feeds = [
        ("CONTRACTOR", fx.contractor_feed(w.table("customer"))),
        ("SUPPLIER", fx.supplier_feed(w.table("supplier"))),
        ("CLIENT", fx.client_feed(w.table("customer"), fx.order_summary(w.table("orders")))),
    ]
    rows = staging.load_metadata(c.company_union(feeds), fx.DEFAULT_SOURCE, fx.NOW)
    return rows.select("object_id", "role_code", LOAD_DATE, RECORD_SOURCE)


# -- hubs, links, satellites -----------------------------------------------------


@query_in_place
def hub_company(w: fx.Warehouse) -> DataFrame:
    return w.hub_company


@query
def hub_country(w: fx.Warehouse) -> DataFrame:
    return w.hub_country


@query
def hub_project(w: fx.Warehouse) -> DataFrame:
    return w.hub_project


def _user_hub_rows(df: DataFrame, key: str, ts: str, source: str) -> DataFrame:
    rows = df.select(F.col(key).cast("string").alias("user_code"), F.col(ts).alias(LOAD_DATE), F.lit(source).alias(RECORD_SOURCE))
    return rows.withColumn("hk_user", hashing.hash_key(rows, "user_code"))


@query
def hub_incremental(w: fx.Warehouse) -> DataFrame:
    """Buyers the hub does not know yet from the event stream."""
    known = loads.load_hub(_user_hub_rows(w.table("events"), "user_id", "ts", "events"), "hk_user", ["user_code"])
    staged = _user_hub_rows(w.table("orders"), "o_custkey", "o_orderdate", "orders")
    return loads.load_hub(staged, "hk_user", ["user_code"], known)


@query
def link_incremental(w: fx.Warehouse) -> DataFrame:
    """Customer and priority pairs first ordered in or after 1998."""
    orders = w.table("orders").select(
        F.col("o_custkey").cast("string").alias("user_code"),
        F.col("o_orderpriority").alias("priority_code"),
        F.col("o_orderdate").alias(LOAD_DATE),
        F.lit("orders").alias(RECORD_SOURCE),
    )
    staged = orders.select(
        "*",
        hashing.hash_key(orders, "user_code").alias("hk_user"),
        hashing.hash_key(orders, "priority_code").alias("hk_priority"),
        hashing.link_hash_key(orders, ["user_code"], ["priority_code"]).alias("hk_link_user_priority"),
    )
    link = ("hk_link_user_priority", ["hk_user", "hk_priority"])
    start = F.lit("1998-01-01").cast("timestamp_ntz")
    existing = loads.load_link(staged.where(F.col(LOAD_DATE) < start), *link, extra=["priority_code"])
    return loads.load_link(staged.where(F.col(LOAD_DATE) >= start), *link, existing, extra=["priority_code"])


@query_in_place
def link_company_role(w: fx.Warehouse) -> DataFrame:
    return w.link_role


@query_in_place
def link_company_country(w: fx.Warehouse) -> DataFrame:
    return w.link_country


@query
def sat_company(w: fx.Warehouse) -> DataFrame:
    return w.sat_company


@query
def sat_country(w: fx.Warehouse) -> DataFrame:
    return w.sat_country


@query
def sat_project(w: fx.Warehouse) -> DataFrame:
    return w.sat_project


@query
def sat_subset(w: fx.Warehouse) -> DataFrame:
    return w.sat_client_ext


def _two_batches(w: fx.Warehouse, compare: str) -> DataFrame:
    s = c.SAT_COMPANY
    args = (s.hk, s.hd, ("name", "subscription", "credit_rating", "country"))
    first = loads.load_satellite(w.staged_batch(1), *args)
    return first.unionByName(loads.load_satellite(w.staged_batch(2), *args, first, compare))


@query
def sat_two_batch(w: fx.Warehouse) -> DataFrame:
    return _two_batches(w, "any")


@query
def sat_two_batch_latest(w: fx.Warehouse) -> DataFrame:
    return _two_batches(w, "latest")


def _events(w: fx.Warehouse) -> DataFrame:
    return fx.event_feed(w.table("events"))


@query
def sat_replay_any(w: fx.Warehouse) -> DataFrame:
    return replay.replay_satellite(_events(w), "batch", "hk_user", "hd_user", fx.EVENT_PAYLOAD)


@query
def sat_replay_latest(w: fx.Warehouse) -> DataFrame:
    return replay.replay_satellite(_events(w), "batch", "hk_user", "hd_user", fx.EVENT_PAYLOAD, "latest")


def _user_versions(w: fx.Warehouse) -> DataFrame:
    """The replayed satellite on storage; what follows reads it more than once."""
    return w.keep("sat_user", sat_replay_latest(w))


@query
def sat_reload(w: fx.Warehouse) -> DataFrame:
    """All orders of a customer's last day are tied versions; loading them again adds nothing."""
    rows = _order_versions(w).withColumn("hd_user", F.sha2(F.col("order_key").cast("string"), 256)).withColumn(RECORD_SOURCE, F.lit("orders"))
    args = ("hk_user", "hd_user", ("order_key", "state"))
    first = w.keep("first", loads.load_satellite(rows, *args))
    newest = loads.latest_diff(first, "hk_user", "hd_user")
    again = loads.load_satellite(rows.join(newest, ["hk_user", "hd_user"], "left_semi"), *args, first, "latest")
    return first.unionByName(again).drop(END_DATE)


@query
def hub_replay(w: fx.Warehouse) -> DataFrame:
    return replay.replay_hub(_events(w), "batch", "hk_user", ["user_code"])


@query
def link_replay(w: fx.Warehouse) -> DataFrame:
    return replay.replay_link(_events(w), "batch", "hk_link_user_type", ["hk_user", "hk_type"])


PRODUCT = EntitySpec(
    name="product",
    business_keys=("object_id",),
    attributes=("name", "kind", "size", "price"),
    foreign_keys={"brand": "brand"},
    default_source=fx.DEFAULT_SOURCE,
    now=fx.NOW,
)


def _products(w: fx.Warehouse) -> DataFrame:
    return PRODUCT.stage(
        w.table("part").select(
            F.col("p_partkey").alias("object_id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("kind"),
            F.col("p_size").alias("size"),
            F.col("p_retailprice").alias("price"),
            F.col("p_brand").alias("brand"),
        )
    )


@query
def hub_product(w: fx.Warehouse) -> DataFrame:
    (hub,) = PRODUCT.vault().hubs
    return loads.load_hub(_products(w), hub.hk, hub.business_keys)


@query
def sat_product(w: fx.Warehouse) -> DataFrame:
    (sat,) = PRODUCT.vault().satellites
    return history.close_versions(loads.load_satellite(_products(w), sat.hk, sat.hd, sat.payload), sat.hk)


@query
def link_product_brand(w: fx.Warehouse) -> DataFrame:
    (link,) = PRODUCT.vault().links
    return loads.load_link(_products(w), link.link_hk, link.hub_hks, not_null=link.not_null)


# -- history ---------------------------------------------------------------------


def _closed_users(w: fx.Warehouse) -> DataFrame:
    return history.close_versions(_user_versions(w), "hk_user")


@query
def sat_closed(w: fx.Warehouse) -> DataFrame:
    return _closed_users(w)


def _order_versions(w: fx.Warehouse) -> DataFrame:
    """Each order is a version of its customer; some customers order twice a day."""
    rows = w.table("orders").select(
        F.col("o_custkey").cast("string").alias("user_code"),
        F.col("o_orderkey").alias("order_key"),
        F.col("o_orderstatus").alias("state"),
        F.col("o_orderdate").alias(LOAD_DATE),
    )
    return rows.select(hashing.hash_key(rows, "user_code").alias("hk_user"), "order_key", "state", LOAD_DATE)


@query
def sat_closed_ties(w: fx.Warehouse) -> DataFrame:
    return history.close_versions(_order_versions(w), "hk_user")


def _late_arrivals(w: fx.Warehouse) -> DataFrame:
    """Versions of days 16 to 20 arrive after all others were closed."""
    rows = w.keep("versions", loads.open_version(_events(w).select("hk_user", *fx.EVENT_PAYLOAD, LOAD_DATE)))
    late = F.to_date(LOAD_DATE).between("2024-01-16", "2024-01-20")
    on_time = history.close_versions(rows.where(~late), "hk_user")
    return w.keep("sat_user_state", on_time.unionByName(rows.where(late)))


@query
def sat_closed_strict(w: fx.Warehouse) -> DataFrame:
    return history.close_open_only(_late_arrivals(w), "hk_user")


@query
def interval_overlaps(w: fx.Warehouse) -> DataFrame:
    """Closing moves no load date, so both steps share the times that follow."""
    state = _late_arrivals(w)
    later = history.next_later(state, "hk_user", LOAD_DATE)
    closed = w.keep("sat_user_closed", history.close_open_only(state, "hk_user", later=later))
    return history.interval_overlaps(closed, "hk_user", later=later)


@query
def eff_sat_company_country(w: fx.Warehouse) -> DataFrame:
    return w.eff_country


@query
def eff_sat_two_batch(w: fx.Warehouse) -> DataFrame:
    s = c.EFF_COUNTRY
    args = (s.link_hk, s.driving_hk, s.hub_hks)
    first = loads.load_eff_satellite(w.staged_batch(1), *args)
    return first.unionByName(loads.load_eff_satellite(w.staged_batch(2), *args, first))


@query
def eff_sat_driving_start(w: fx.Warehouse) -> DataFrame:
    s = c.EFF_COUNTRY
    args = (s.link_hk, s.driving_hk, s.hub_hks)
    first = loads.load_eff_satellite(w.staged_batch(1), *args, mode="driving_start")
    return first.unionByName(loads.load_eff_satellite(w.staged, *args, first, mode="driving_start"))


EVENT_LINK = ("hk_link_user_type", "hk_user", ("hk_user", "hk_type"))


@query
def eff_sat_replay(w: fx.Warehouse) -> DataFrame:
    return replay.replay_eff_satellite(_events(w), "batch", *EVENT_LINK)


@query
def eff_closed(w: fx.Warehouse) -> DataFrame:
    return history.close_relationships(w.keep("eff_sat_user_type", eff_sat_replay(w)), "hk_user")


@query
def relationship_as_of(w: fx.Warehouse) -> DataFrame:
    return history.relationship_as_of(eff_closed(w), MOMENT)


@query_in_place
def ghost_hub(w: fx.Warehouse) -> DataFrame:
    return ghosts.insert_ghosts(w.hub_company, "hk_company", "hub")


@query
def ghost_sat(w: fx.Warehouse) -> DataFrame:
    once = ghosts.insert_ghosts(w.sat_country, "hk_country", "satellite", "hd_country")
    return ghosts.insert_ghosts(once, "hk_country", "satellite", "hd_country")


@query
def resolve_key(w: fx.Warehouse) -> DataFrame:
    feed = fx.client_feed(w.table("customer"), fx.order_summary(w.table("orders")))
    key = hashing.fk_hash_key(feed, "country")
    return feed.select("object_id", hashing.resolve_key(F.col("country"), F.col("country") <= 20, key).alias("hk_country"))


@query
def sat_current(w: fx.Warehouse) -> DataFrame:
    return history.current(_closed_users(w))


@query
def sat_history(w: fx.Warehouse) -> DataFrame:
    key = hashlib.sha256(b"8").hexdigest().upper()
    return history.history(_closed_users(w), "hk_user", key)


@query
def sat_as_of(w: fx.Warehouse) -> DataFrame:
    return history.as_of(_closed_users(w), MOMENT)


@query
def evolve_satellite(w: fx.Warehouse) -> DataFrame:
    """The value becomes part of the diff, a region attribute is added."""
    return evolve.evolve(_closed_users(w), "hd_user", ["event_type", "value"], add={"region": "string"}, drop=[RECORD_SOURCE], sep="^^")


# -- business vault ----------------------------------------------------------------


@query
def snapshot_spine(w: fx.Warehouse) -> DataFrame:
    return pit.snapshot_spine([_order_versions(w), _user_versions(w)])


def _user_hub(w: fx.Warehouse) -> DataFrame:
    return replay.replay_hub(_events(w), "batch", "hk_user", ["user_code"])


@query
def pit_user(w: fx.Warehouse) -> DataFrame:
    return pit.pit(_user_hub(w), _user_versions(w), "hk_user", "sat_user", fx.NOW)


@query
def pit_refreshed(w: fx.Warehouse) -> DataFrame:
    """The same table, brought up to date week by week: each refresh reads the last
    kept day and what was loaded after it. The first week's first load comes late."""
    versions, hub, table = _user_versions(w), w.keep("hub_user", _user_hub(w)), f"{w.folder}/pit_user"
    week = F.to_date(F.date_trunc("week", LOAD_DATE))
    weeks = [r[0] for r in versions.select(week).distinct().orderBy(week).collect()]  # as many as the calendar has
    late = versions.agg(F.min(F.to_date(LOAD_DATE))).first()[0]
    for one in weeks:
        known = versions.where((week <= F.lit(one)) & (F.to_date(LOAD_DATE) > F.lit(late)))
        pit.refresh_pit(table, hub, known, "hk_user", "sat_user", fx.NOW, changed_from=one)
    pit.refresh_pit(table, hub, versions, "hk_user", "sat_user", fx.NOW, changed_from=late)
    return pit.stored_pit(w.spark, table)


@query
def pit_company(w: fx.Warehouse) -> DataFrame:
    return pit.pit(w.hub_company, w.sat_company, "hk_company", "sat_company", fx.NOW)


@query
def pit_weekly(w: fx.Warehouse) -> DataFrame:
    """Snapshots on Mondays instead of every load day."""
    mondays = w.table("events").select(F.to_date(F.date_trunc("week", "ts")).alias("snapshot_date")).distinct()
    return pit.pit(_user_hub(w), _user_versions(w), "hk_user", "sat_user", fx.NOW, spine=mondays)


@query
def pit_multi(w: fx.Warehouse) -> DataFrame:
    sats = {"sat_user": _user_versions(w), "sat_order": _order_versions(w)}
    hub = loads.load_hub(_user_hub_rows(w.table("events"), "user_id", "ts", "events"), "hk_user", ["user_code"])
    months = w.table("orders").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("snapshot_date")).distinct()
    return pit.pit_multi(hub, sats, "hk_user", spine=months)


@query
def pit_lookup(w: fx.Warehouse) -> DataFrame:
    sat = _user_versions(w)
    # Rebuilt as a table partitioned by day: the lookup reads one partition.
    table = w.keep("pit_user", pit.pit(_user_hub(w), sat, "hk_user", "sat_user", fx.NOW), ["snapshot_date"])
    return pit.pit_lookup(table, sat.select("hk_user", LOAD_DATE, *fx.EVENT_PAYLOAD), "hk_user", SNAPSHOT, "sat_user_load_date")


@query
def bridge_company(w: fx.Warehouse) -> DataFrame:
    links = [
        (w.link_country, "hk_link_company_country", ["hk_country"]),
        (w.link_role, "hk_link_company_role", ["hk_role"]),
    ]
    return pit.bridge(w.hub_company, "hk_company", links)


# -- marts ---------------------------------------------------------------------------


@query
def mart_company_current(w: fx.Warehouse) -> DataFrame:
    return c.company_current(w.hub_company, w.sat_company)


@query
def mart_company_flat(w: fx.Warehouse) -> DataFrame:
    return c.company_current_flat(w.sat_company)


@query
def mart_countries(w: fx.Warehouse) -> DataFrame:
    return c.country_view(w.hub_country, w.sat_country)


@query
def mart_country_names(w: fx.Warehouse) -> DataFrame:
    """The same view, published under a name and read back."""
    name = sinks.publish_view(c.country_view(w.hub_country, w.sat_country), "v_country_names")
    return w.spark.table(name)


@query
def mart_country_view(w: fx.Warehouse) -> DataFrame:
    """The view in a schema of its own, over a stored table; a view that became obsolete is dropped."""
    path = f"{w.folder}/v_countries"
    sinks.write_overwrite(c.country_view(w.hub_country, w.sat_country), path)
    select = f"SELECT * FROM parquet.`{sinks.current_path(w.spark, path)}`"
    obsolete = sinks.publish_sql_view(w.spark, select, "v_countries_before", "mart")
    name = sinks.publish_sql_view(w.spark, select, "v_countries", "mart")
    sinks.drop_views(w.spark, [obsolete, "mart.v_never_there"])
    if w.spark.catalog.tableExists(obsolete):
        raise RuntimeError(f"{obsolete} is still there")
    return w.spark.table(name)


@query
def mart_company_top3(w: fx.Warehouse) -> DataFrame:
    return c.company_top3(w.hub_company, w.sat_company)


@query
def mart_company_top3_described(w: fx.Warehouse) -> DataFrame:
    return c.company_top3(w.hub_company, w.sat_company, limited=True)


@query
def mart_company_top5(w: fx.Warehouse) -> DataFrame:
    return c.company_top5(w.hub_company, w.sat_company)


@query
def mart_company_top5_described(w: fx.Warehouse) -> DataFrame:
    return c.company_top5(w.hub_company, w.sat_company, limited=True)


@query
def mart_top10_customers(w: fx.Warehouse) -> DataFrame:
    return c.top10_customers(w.hub_company, w.sat_company)


@query
def mart_top10_customers_described(w: fx.Warehouse) -> DataFrame:
    return c.top10_customers(w.hub_company, w.sat_company, limited=True)


@query
def mart_company_extended(w: fx.Warehouse) -> DataFrame:
    return c.company_extended(w.hub_company, w.sat_company, w.link_country, w.sat_country)


@query
def mart_company_full(w: fx.Warehouse) -> DataFrame:
    return c.company_full(w.hub_company, w.sat_company, w.link_role, w.roles, w.link_country, w.sat_country)


def _stored(w: fx.Warehouse, *company: str) -> fx.Warehouse:
    return w.bucketed(**dict.fromkeys(("hub_company", "sat_company", *company), "hk_company"), sat_country="hk_country")


@query
def mart_company_current_stored(w: fx.Warehouse) -> DataFrame:
    """The marts over vault tables in buckets: no exchange by company is left in them."""
    w = _stored(w)
    return c.company_current(w.hub_company, w.sat_company)


@query
def mart_company_extended_stored(w: fx.Warehouse) -> DataFrame:
    w = _stored(w, "link_country")
    return c.company_extended(w.hub_company, w.sat_company, w.link_country, w.sat_country)


@query
def mart_company_full_stored(w: fx.Warehouse) -> DataFrame:
    w = _stored(w, "link_country", "link_role")
    return c.company_full(w.hub_company, w.sat_company, w.link_role, w.roles, w.link_country, w.sat_country)


@query
def mart_star_aliases(w: fx.Warehouse) -> DataFrame:
    """All attributes of country and company, colliding names prefixed."""
    sat = w.sat_company.select("hk_company", "name", "subscription", "credit_rating", IS_CURRENT)
    return marts.mart(
        w.hub_company,
        "hk_company",
        [marts.SatelliteSource("sat_company", sat)],
        [marts.LinkSource("link_company_country", w.link_country, "hk_country", marts.SatelliteSource("sat_country", w.sat_country, ()))],
    )


@query
def companies_in_country(w: fx.Warehouse) -> DataFrame:
    return c.companies_in(w.sat_company, w.link_country, w.sat_country, "NATION_7")


# -- reports and checks ----------------------------------------------------------------


@query_in_place
def client_count(w: fx.Warehouse) -> DataFrame:
    return quality.count_where(w.link_role, F.col("role_code") == "CLIENT")


@query_in_place
def count_by_role(w: fx.Warehouse) -> DataFrame:
    return quality.count_by(w.link_role, "role_code")


@query_in_place
def count_by_country(w: fx.Warehouse) -> DataFrame:
    return quality.count_by(w.link_country, "hk_country")


@query
def reconciliation(w: fx.Warehouse) -> DataFrame:
    w = w.store("hub_company", "hub_country", "sat_company", "link_country")
    return quality.load_reconciliation(
        [
            ("hub_company", w.staged, w.hub_company),
            ("hub_country", w.staged_country, w.hub_country),
            ("sat_company", w.staged, w.sat_company),
            ("link_company_country", w.staged, w.link_country),
        ]
    )


@query
def table_stats(w: fx.Warehouse) -> DataFrame:
    names = (
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
        "pages", "benchmark", "labels", "conversations",
    )
    return quality.table_stats({n: w.table(n) for n in names})


@query
def duplicate_keys(w: fx.Warehouse) -> DataFrame:
    return quality.duplicate_keys(w.sat_company, ["hk_company"])


@query
def first_and_last_load(w: fx.Warehouse) -> DataFrame:
    return _order_versions(w).groupBy("hk_user").agg(F.min(LOAD_DATE).alias("first_load"), F.max(LOAD_DATE).alias("last_load"))


@query_in_place
def check_not_null(w: fx.Warehouse) -> DataFrame:
    return quality.not_null(w.staged, "country").select("hk_company", "object_id", "role_code", "batch")


@query_in_place
def check_unique(w: fx.Warehouse) -> DataFrame:
    return quality.unique(w.hub_company, "object_id")


@query
def check_accepted(w: fx.Warehouse) -> DataFrame:
    return quality.accepted_values(w.table("events"), "event_type", ("click", "view"))


@query
def check_relationships(w: fx.Warehouse) -> DataFrame:
    return quality.relationships(w.eff_country, "hk_country", w.hub_country, "hk_country").select("hk_company", "hk_country", START_DATE)


@query
def check_suite(w: fx.Warehouse) -> DataFrame:
    w = w.store(
        "hub_company", "hub_country", "sat_company", "sat_country", "sat_client_ext", "link_role", "link_country"
    )
    tables = {
        "stg_company": w.staged,
        "stg_country": w.staged_country,
        "hub_company": w.hub_company,
        "hub_country": w.hub_country,
        "sat_company": w.sat_company,
        "sat_country": w.sat_country,
        "sat_company_client_ext": w.sat_client_ext,
        "link_company_role": w.link_role,
        "link_company_country": w.link_country,
        "v_company_top5": c.company_top5(w.hub_company, w.sat_company),
        "v_top10_customers": c.top10_customers(w.hub_company, w.sat_company),
        "v_countries": c.country_view(w.hub_country, w.sat_country),
        "v_company_current": c.company_current(w.hub_company, w.sat_company),
        "v_company_extended": c.company_extended(w.hub_company, w.sat_company, w.link_country, w.sat_country),
        "ref_role": w.roles,
        "ext_company_client": fx.client_feed(w.table("customer"), fx.order_summary(w.table("orders"))).select("object_id").union(
            fx.client_redelivery(w.table("customer"), fx.order_summary(w.table("orders"))).select("object_id")
        ),
        "ext_project": fx.project_feed(w.table("orders")),
    }
    return quality.run_checks(tables, c.CHECKS)


@query
def orphans(w: fx.Warehouse) -> DataFrame:
    """Order histories of customers that never showed up in the event hub."""
    return quality.orphans(_order_versions(w), _user_hub(w), "hk_user")


# -- document index -----------------------------------------------------------------------

SEPARATOR = r"\n+"


def _source_file():
    return F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id"), F.lit(".md"))


@query
def chunks(w: fx.Warehouse) -> DataFrame:
    return corpus.chunk_documents(w.table("documents"), "doc_id", "text", separator=SEPARATOR)


@query
def chunk_metadata(w: fx.Warehouse) -> DataFrame:
    rows = corpus.chunk_documents(w.table("documents"), "doc_id", "text", separator=SEPARATOR, with_metadata=True)
    return rows.select("doc_id", "chunk_index", F.array_join("headers", "\n").alias("headers"), "section")


@query
def page_chunk_metadata(w: fx.Warehouse) -> DataFrame:
    """Chunks of web pages: titles and headings are the headers, and the sections of what follows."""
    pages = w.table("pages").select("page_id", markup.markdown_of(F.col("html")).alias("text"))
    rows = corpus.chunk_documents(pages, "page_id", "text", with_metadata=True)
    return rows.select("page_id", "chunk_index", F.array_join("headers", "\n").alias("headers"), "section")


def _old_index(w: fx.Warehouse) -> DataFrame:
    """The index before: labelled documents carry another text, some sources were unknown."""
    labels = w.table("labels").where("toxic = 1").select("doc_id", F.lit(True).alias("flagged"))
    old = (
        w.table("documents")
        .where("lang <> 'de'")
        .join(labels, "doc_id", "left")
        .select("doc_id", F.when(F.col("flagged"), F.concat(F.lit("Draft.\n"), "text")).otherwise(F.col("text")).alias("text"))
    )
    return w.keep("index", corpus.index_documents(old, "doc_id", "text", separator=SEPARATOR))


@query
def reindex_plan(w: fx.Warehouse) -> DataFrame:
    return corpus.reindex_plan(w.table("documents"), _old_index(w), "doc_id", "text")


@query
def incremental_reindex(w: fx.Warehouse) -> DataFrame:
    return corpus.incremental_reindex(w.table("documents"), _old_index(w), "doc_id", "text", separator=SEPARATOR)


@query
def reindex_stored(w: fx.Warehouse) -> DataFrame:
    """The same on a stored index, of which only the parts with changed documents are written."""
    path = f"{w.folder}/chunks"
    corpus.write_index(_old_index(w), path, "doc_id")
    corpus.refresh_index(w.table("documents"), path, "doc_id", "text", separator=SEPARATOR)
    return corpus.read_index(w.spark, path)


@query
def chunk_stats(w: fx.Warehouse) -> DataFrame:
    return corpus.chunk_stats(corpus.chunk_documents(w.table("documents"), "doc_id", "text", separator=SEPARATOR), "doc_id")


@query
def index_stats(w: fx.Warehouse) -> DataFrame:
    rows = corpus.chunk_documents(w.table("documents"), "doc_id", "text", separator=SEPARATOR)
    return corpus.index_stats(rows, "doc_id").withColumn("avg_chunks_per_doc", F.round("avg_chunks_per_doc", 6))


@query
def duplicate_content(w: fx.Warehouse) -> DataFrame:
    return corpus.duplicate_content(w.table("documents"), "doc_id", "text")


def _centroids(w: fx.Warehouse) -> DataFrame:
    """One query per label: the mean of the label's vectors."""
    parts = w.table("embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vector = F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])
    return means.groupBy(F.col("label").alias("query_id")).agg(vector.alias("embedding"))


@query
def cosine_to_label(w: fx.Warehouse) -> DataFrame:
    """How close every vector is to the mean of its label."""
    means = _centroids(w).select(F.col("query_id").alias("label"), F.col("embedding").alias("mean"))
    close = vectors.cosine_similarity(F.col("embedding"), F.col("mean"))
    return w.table("embeddings").join(means, "label").select("vec_id", "label", F.round(close, 6).alias("similarity"))


def _search(w: fx.Warehouse, k: int, threshold: float | None) -> DataFrame:
    found = similarity.similarity_search(_centroids(w), w.table("embeddings"), k=k, threshold=threshold)
    return found.withColumn("similarity", F.round("similarity", 6))


@query
def similar_topk(w: fx.Warehouse) -> DataFrame:
    return _search(w, 5, None)


@query
def similar_threshold(w: fx.Warehouse) -> DataFrame:
    return _search(w, 20, 0.3)


MAX_BROADCAST_HITS = 100_000


@query
def context(w: fx.Warehouse) -> DataFrame:
    """Contexts of the label queries; vector n belongs to document n."""
    hits = w.keep("hits", _search(w, 5, 0.3))
    if hits.count() <= MAX_BROADCAST_HITS:  # k rows a query; beyond that Spark chooses the join
        hits = F.broadcast(hits)
    docs = w.table("documents").select(
        F.col("doc_id").alias("vec_id"), _source_file().alias("source_file"), F.col("lang").alias("section"), F.col("text").alias("content")
    )
    return corpus.assemble_context(docs.join(hits, "vec_id"), "query_id")


# -- logs and lineage --------------------------------------------------------------------


@query
def upsert(w: fx.Warehouse) -> DataFrame:
    """User objects of the first half month, updated by the second half."""
    rows = w.table("events").select(
        "user_id", F.col("event_type").alias("state"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at")
    )
    half = F.lit(HALF_TIME).cast("timestamp_ntz")
    start = rows.where(F.col("updated_at") < half).groupBy("user_id").agg(
        F.max_by("state", F.struct("updated_at", "state")).alias("state"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at")
    )
    return logs.upsert(start, rows.where(F.col("updated_at") >= half), ["user_id"])


@query
def recent_messages(w: fx.Warehouse) -> DataFrame:
    return logs.recent_per_key(w.table("conversations"), "conv_id", [F.col("turn").desc()], 3)


@query
def session_messages(w: fx.Warehouse) -> DataFrame:
    """Every message of each session, in order."""
    return logs.recent_per_key(w.table("conversations"), "conv_id", [F.col("turn").asc()])


@query
def latest_status(w: fx.Warehouse) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "error").otherwise("skipped")
    runs = w.table("events").select(F.col("user_id").alias("model_key"), status.alias("status"), "ts", "event_id")
    models = w.table("customer").select(F.col("c_custkey").alias("model_key"))
    return logs.latest_status(runs, models, "model_key", "status", ["ts", "event_id"])


def _edges(w: fx.Warehouse) -> DataFrame:
    def edge(df: DataFrame, left: str, left_key: str, right: str, right_key: str) -> DataFrame:
        return df.select(
            F.concat(F.lit(left), F.col(left_key)).alias("src"), F.concat(F.lit(right), F.col(right_key)).alias("dst")
        )

    return (
        edge(w.table("orders"), "order:", "o_orderkey", "customer:", "o_custkey")
        .unionByName(edge(w.table("customer"), "customer:", "c_custkey", "nation:", "c_nationkey"))
        .unionByName(edge(w.table("nation"), "nation:", "n_nationkey", "region:", "n_regionkey"))
    )


@query
def reachable_down(w: fx.Warehouse) -> DataFrame:
    """Everything urgent orders touch."""
    urgent = w.table("orders").where("o_orderpriority = '1-URGENT'")
    return lineage.reachable(_edges(w), urgent.select(F.concat(F.lit("order:"), "o_orderkey").alias("node")))


@query
def reachable_up(w: fx.Warehouse) -> DataFrame:
    """Everything that leads to a region."""
    regions = w.table("region").where("r_name = 'ASIA'").select(F.concat(F.lit("region:"), "r_regionkey").alias("node"))
    return lineage.reachable(_edges(w), regions, direction="up")


@query
def neighbours(w: fx.Warehouse) -> DataFrame:
    return lineage.direct_neighbours(_edges(w), "nation:7", "up")


# -- loads kept on storage -----------------------------------------------------------------

USER_VAULT = VaultSpec(
    hubs=(HubSpec("hub_user", "hk_user", ("user_code",)),),
    satellites=(SatelliteSpec("sat_user", "hk_user", "hd_user", fx.EVENT_PAYLOAD),),
    eff_satellites=(EffSatelliteSpec("eff_sat_user_type", "hk_link_user_type", "hk_user", ("hk_user", "hk_type")),),
)


def _weekly(w: fx.Warehouse) -> list[DataFrame]:
    """All events, one batch per week, staged as they are read: hashes take many times
    the room of the events, and a load keeps its staged rows while it runs."""
    events = w.table("events").select("ts", "user_id", "event_type", "value")
    stored = w.keep("weeks", events.withColumn("week", F.to_date(F.date_trunc("week", "ts"))), partition_by=["week"])
    weeks = [r[0] for r in stored.select("week").distinct().orderBy("week").collect()]
    feeds = [fx.event_feed(stored.where(F.col("week") == week).drop("week")) for week in weeks]
    return [feed.withColumn("batch", F.to_date(F.date_trunc("week", LOAD_DATE))) for feed in feeds]


def _loaded(w: fx.Warehouse) -> Vault:
    vault = Vault(w.spark, f"{w.folder}/vault", USER_VAULT)
    vault.run(_weekly(w))
    return vault


@query
def batches_satellite(w: fx.Warehouse) -> DataFrame:
    return _loaded(w).satellite(USER_VAULT.satellites[0])


@query
def batches_eff_satellite(w: fx.Warehouse) -> DataFrame:
    return _loaded(w).eff_satellite(USER_VAULT.eff_satellites[0])


@query
def batches_compacted(w: fx.Warehouse) -> DataFrame:
    """Loads whose folders are folded into one as they come."""
    vault = Vault(w.spark, f"{w.folder}/vault", USER_VAULT)
    for load_id, week in enumerate(_weekly(w)):
        vault.load(week, load_id)
        vault.compact(load_id - 1)
    return vault.satellite(USER_VAULT.satellites[0])


@query
def stream_satellite(w: fx.Warehouse) -> DataFrame:
    """Event files arrive week by week; the stream goes on where it stopped, one load per micro-batch."""
    vault = Vault(w.spark, f"{w.folder}/vault", USER_VAULT)
    events, arrived = w.table("events"), f"{w.folder}/arrived"
    week = F.to_date(F.date_trunc("week", "ts"))
    for (one,) in events.select(week).distinct().orderBy(week).collect():  # as many as the calendar has weeks
        events.where(week == F.lit(one)).write.mode("append").parquet(arrived)
        feed = feed_stream(w.spark, arrived, events.schema)
        stream_loads(feed, fx.event_feed, vault, f"{w.folder}/progress").awaitTermination()
    return vault.satellite(USER_VAULT.satellites[0])


@query
def stream_state_satellite(w: fx.Warehouse) -> DataFrame:
    """The same arrivals against Spark's state store: no micro-batch reads an earlier load."""
    (sat,) = USER_VAULT.satellites
    events, arrived, table = w.table("events"), f"{w.folder}/arrived", f"{w.folder}/{sat.name}"
    week = F.to_date(F.date_trunc("week", "ts"))
    for (one,) in events.select(week).distinct().orderBy(week).collect():  # as many as the calendar has weeks
        events.where(week == F.lit(one)).write.mode("append").parquet(arrived)
        feed = feed_stream(w.spark, arrived, events.schema)
        stream_versions(fx.event_feed(feed), sat, table, f"{w.folder}/progress").awaitTermination()
    return history.close_versions(sinks.read_appended(w.spark, table), sat.hk)
