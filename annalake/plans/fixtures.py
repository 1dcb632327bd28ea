"""The given tables seen as the feeds of a historised warehouse.

customer is the client feed, its MACHINERY segment the contractor feed,
supplier the supplier feed (key ranges overlap, as business keys do), nation the
country feed, orders the project feed. Clients with orders are delivered a
second time with values taken from their orders, so satellites get versions and
some clients move to another country. events is a daily change feed.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalake.functions.hashing import hash_diff, hash_key, link_hash_key
from annalake.operators import history, loads, replay
from annalake.operators.staging import stage
from annalake.plans import company as c
from annalake.session import tune
from annalake.sources import sinks
from annalake.sources.readers import read_source
from annalake.specs import LOAD_DATE, RECORD_SOURCE

NOW = "2024-02-01 00:00:00"
FIRST_LOAD = "2024-01-05 06:00:00"
SECOND_LOAD = "2024-03-01 06:30:00"
DEFAULT_SOURCE = "portal"
BATCH = T.StructField("batch", T.IntegerType())


# Columns of the given tables with their types.
GIVEN = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_source(tune(spark), f"{sf_dir}/{name}.parquet", GIVEN[name])


def money(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)")


def order_summary(orders: DataFrame) -> DataFrame:
    """What the client feed knows about a customer's orders, one row per customer."""
    newest = F.struct("o_orderdate", "o_orderkey")
    return orders.groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("first_order"),
        F.max("o_orderdate").alias("last_order"),
        F.sum(money("o_totalprice")).cast("string").alias("total"),
        F.max_by("o_orderpriority", newest).alias("priority"),
        F.max_by("o_orderstatus", newest).alias("status"),
    )


def _company(prefix: str, **given: Column) -> dict[str, Column]:
    key = "custkey" if prefix == "c" else "suppkey"
    columns = {
        "object_id": F.col(f"{prefix}_{key}"),
        "name": F.col(f"{prefix}_name"),
        # Nation 0 plays the feed row without a country.
        "country": F.nullif(F.col(f"{prefix}_nationkey").cast("bigint"), F.lit(0)),
        "credit_rating": money(f"{prefix}_acctbal").cast("string"),
    }
    return {**columns, **given}


def _select(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select(*[col.alias(name) for name, col in columns.items()])


def client_feed(customer: DataFrame, summary: DataFrame) -> DataFrame:
    rows = customer.join(summary, F.col("c_custkey") == F.col("o_custkey"), "left")
    exempt = F.when(F.col("status") == "F", F.col("last_order"))
    return _select(
        rows,
        _company(
            "c",
            subscription=F.col("c_mktsegment"),
            date_created=F.col("first_order"),
            freistellungsbescheinigung=exempt,
            dss_record_source=F.lit("crm"),
            dss_load_date=F.lit(FIRST_LOAD),
            batch=F.lit(1),
        ),
    )


def client_redelivery(customer: DataFrame, summary: DataFrame) -> DataFrame:
    """Second delivery: clients with orders, changed by what they ordered."""
    rows = customer.join(summary, F.col("c_custkey") == F.col("o_custkey"))
    moved = F.when(F.col("status") == "P", (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey"))
    return _select(
        rows,
        _company(
            "c",
            country=F.nullif(moved.cast("bigint"), F.lit(0)),
            subscription=F.when(F.col("status") == "O", F.col("c_mktsegment")).otherwise(F.col("priority")),
            credit_rating=F.when(F.col("status") == "O", money("c_acctbal").cast("string")).otherwise(F.col("total")),
            date_created=F.col("first_order"),
            date_updated=F.col("last_order"),
            freistellungsbescheinigung=F.when(F.col("status") == "F", F.col("last_order")),
            dss_record_source=F.lit("crm"),
            dss_load_date=F.lit(SECOND_LOAD),
            batch=F.lit(2),
        ),
    )


def contractor_feed(customer: DataFrame) -> DataFrame:
    rows = customer.where("c_mktsegment = 'MACHINERY'")
    return _select(rows, _company("c", dss_load_date=F.lit("n/a"), batch=F.lit(1)))


def supplier_feed(supplier: DataFrame) -> DataFrame:
    return _select(
        supplier,
        _company("s", employeecount=money("s_acctbal").cast("decimal(38,18)"), batch=F.lit(1)),
    )


def country_feed(nation: DataFrame) -> DataFrame:
    return nation.select(
        F.col("n_nationkey").cast("bigint").alias("object_id"), F.col("n_name").alias("name")
    )


def project_feed(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("object_id"),
        F.col("o_orderpriority").alias("name"),
        F.col("o_orderstatus").alias("state"),
        F.col("o_orderdate").alias("begin"),
        money("o_totalprice").cast("decimal(38,18)").alias("price"),
        F.col("o_custkey").alias("client"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("dss_load_date"),
    )


@dataclass(frozen=True)
class Warehouse:
    """Vault tables of the fixture after both loads.

    The staged company rows are written once and read by every table built
    from them: their hashes are computed once, and each reader takes only the
    columns it needs. ``stored`` keeps the vault tables in the same way, for
    jobs that read them many times; ``direct`` stages in place, for jobs that
    read the staged rows once.
    """

    spark: SparkSession
    sf_dir: str
    stored: bool = False
    direct: bool = False

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def folder(self) -> str:
        return sinks.scratch(self.spark)

    def keep(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """Write a table to the shared folder and read it back."""
        path = f"{self.folder}/{name}"
        sinks.write_overwrite(df, path, partition_by)
        return sinks.read_current(self.spark, path, schema=df.schema)

    def store(self, *names: str) -> Warehouse:
        """This warehouse with the named tables on storage. They need only the
        staged rows, so their jobs are submitted together."""
        kept = replace(self, stored=True)
        _ = kept.folder, kept.staged, kept.staged_country
        with ThreadPoolExecutor(max_workers=8) as pool:
            list(pool.map(lambda name: getattr(kept, name), names))
        return kept

    def bucketed(self, **keys: str) -> Warehouse:
        """This warehouse with the named tables stored in buckets of a key: what joins
        them on it later needs no exchange, however often."""
        kept = replace(self)
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        _ = self.folder, self.staged
        for name, key in keys.items():
            full = f"{name}_{uuid.uuid4().hex}"
            sinks.write_bucketed(getattr(self, name), full, key, buckets, f"{self.folder}/{full}")
            kept.__dict__[name] = self.spark.table(full)
        return kept

    def _vault(self, name: str, df: DataFrame) -> DataFrame:
        return self.keep(name, df) if self.stored else df

    @cached_property
    def staged(self) -> DataFrame:
        return self.staged_view if self.direct else self.keep("stg_company", self.staged_view)

    @cached_property
    def staged_view(self) -> DataFrame:
        customer, supplier = self.table("customer"), self.table("supplier")
        summary = order_summary(self.table("orders"))
        feeds = [
            ("CLIENT", client_feed(customer, summary)),
            ("CONTRACTOR", contractor_feed(customer)),
            ("SUPPLIER", supplier_feed(supplier)),
            ("CLIENT", client_redelivery(customer, summary)),
        ]
        return stage(c.company_union(feeds, [BATCH]), c.company_spec(DEFAULT_SOURCE, NOW, extra=("batch",)))

    def staged_batch(self, batch: int) -> DataFrame:
        return self.staged.where(F.col("batch") == batch)

    @cached_property
    def staged_country(self) -> DataFrame:
        return c.stage_country(country_feed(self.table("nation")), c.country_spec(DEFAULT_SOURCE, NOW))

    @cached_property
    def staged_project(self) -> DataFrame:
        return c.stage_project(project_feed(self.table("orders")), c.project_spec("ext_project", NOW))

    @cached_property
    def hub_company(self) -> DataFrame:
        s = c.HUB_COMPANY
        return self._vault("hub_company", replay.replay_hub(self.staged, "batch", s.hk, s.business_keys))

    @cached_property
    def hub_country(self) -> DataFrame:
        s = c.HUB_COUNTRY
        return self._vault("hub_country", loads.load_hub(self.staged_country, s.hk, s.business_keys))

    @cached_property
    def hub_project(self) -> DataFrame:
        s = c.HUB_PROJECT
        return loads.load_hub(self.staged_project, s.hk, s.business_keys)

    @cached_property
    def sat_company(self) -> DataFrame:
        s = c.SAT_COMPANY
        # Closing reads its rows twice.
        rows = self.keep("sat_company_open", replay.replay_satellite(self.staged, "batch", s.hk, s.hd, s.payload))
        return self._vault("sat_company", history.close_versions(rows, s.hk))

    @cached_property
    def sat_country(self) -> DataFrame:
        s = c.SAT_COUNTRY
        return self._vault("sat_country", history.close_versions(loads.load_satellite(self.staged_country, s.hk, s.hd, s.payload), s.hk))

    @cached_property
    def sat_project(self) -> DataFrame:
        s = c.SAT_PROJECT
        return history.close_versions(loads.load_satellite(self.staged_project, s.hk, s.hd, s.payload), s.hk)

    def client_ext(self, staged: DataFrame, existing: DataFrame | None = None) -> DataFrame:
        s = c.SAT_CLIENT_EXT
        where = (F.col("role_code") == "CLIENT") & F.col(s.payload[0]).isNotNull()
        return loads.load_subset_satellite(staged, s.hk, s.hd, s.payload, where, existing)

    @cached_property
    def sat_client_ext(self) -> DataFrame:
        first = self.client_ext(self.staged_batch(1))
        second = self.client_ext(self.staged_batch(2), first)
        rows = self.keep("sat_company_client_ext_open", first.unionByName(second))
        return self._vault("sat_company_client_ext", history.close_versions(rows, c.SAT_CLIENT_EXT.hk))

    @cached_property
    def link_role(self) -> DataFrame:
        s = c.LINK_ROLE
        return self._vault("link_company_role", replay.replay_link(self.staged, "batch", s.link_hk, s.hub_hks, s.extra))

    @cached_property
    def link_country(self) -> DataFrame:
        s = c.LINK_COUNTRY
        return self._vault("link_company_country", replay.replay_link(self.staged, "batch", s.link_hk, s.hub_hks, not_null=s.not_null))

    @cached_property
    def eff_country(self) -> DataFrame:
        s = c.EFF_COUNTRY
        rows = self.keep("eff_sat_company_country_open", replay.replay_eff_satellite(self.staged, "batch", s.link_hk, s.driving_hk, s.hub_hks))
        return self._vault("eff_sat_company_country", history.close_relationships(rows, s.driving_hk))

    @cached_property
    def roles(self) -> DataFrame:
        return c.role_reference(self.spark, f"{self.folder}/ref_role")


# -- events as change feed -------------------------------------------------------


def event_feed(events: DataFrame) -> DataFrame:
    """Each event is a new state of its user; the day is the batch."""
    return (
        events.select(
            F.col("user_id").cast("string").alias("user_code"),
            "event_type",
            "value",
            F.col("ts").alias(LOAD_DATE),
            F.lit("events").alias(RECORD_SOURCE),
            F.to_date("ts").alias("batch"),
        )
        .transform(
            lambda df: df.withColumns(
                {
                    "hk_user": hash_key(df, "user_code"),
                    "hk_type": hash_key(df, "event_type"),
                    "hk_link_user_type": link_hash_key(df, ["user_code"], ["event_type"]),
                    "hd_user": hash_diff(df, ["event_type"]),
                }
            )
        )
    )


EVENT_PAYLOAD = ("event_type", "value")
