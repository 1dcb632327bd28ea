"""The company / country / project warehouse: staging specs, tables and marts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalake.functions.hashing import KEY_SEPARATOR
from annalake.operators import marts
from annalake.operators.marts import LinkSource, SatelliteSource
from annalake.operators.matching import with_optional
from annalake.operators.quality import Check
from annalake.operators.staging import Feed, stage, union_sources
from annalake.sources.readers import read_seed, write_seed
from annalake.sources.schemas import CLIENT_SCHEMA, COUNTRY_SCHEMA, PROJECT_SCHEMA, ROLE_SCHEMA
from annalake.specs import (
    END_DATE,
    IS_CURRENT,
    LOAD_DATE,
    RECORD_SOURCE,
    EffSatelliteSpec,
    HashSpec,
    HubSpec,
    LinkSpec,
    SatelliteSpec,
    StageSpec,
)

# Column lists, in hashing and display order, tags and seed rows.
COMPANY_DIFF = (
    "name", "street", "citycode", "city", "province", "state", "country", "website",
    "email", "phone", "mobile", "mobile2", "fax", "bic", "iban", "credit_rating",
    "commission_fee", "employeecount", "org_type", "uid", "subscription", "description",
)
COMPANY_PAYLOAD = (
    "name", "subscription", "org_type", "uid", "description", "street", "citycode", "city",
    "province", "state", "country", "website", "email", "phone", "mobile", "mobile2", "fax",
    "bic", "iban", "credit_rating", "commission_fee", "employeecount", "date_created", "date_updated",
)
PROJECT_DIFF = (
    "name", "state", "begin", "location", "price", "commission", "end", "work_begin",
    "author_email", "description", "price_units_value", "commission_units_value", "details",
    "client", "contractor", "member",
)
TOP3_COLUMNS = (
    "name", "org_type", "description", "city", "country", "website", "email", "employeecount", "date_created",
)
TOP5_COLUMNS = (
    "name", "org_type", "city", "country", "email", "phone", "website", "employeecount", "date_created",
)
TOP10_COLUMNS = (
    "name", "subscription", "org_type", "uid", "description", "street", "city", "country",
    "website", "email", "phone", "credit_rating", "employeecount", "date_created",
)
ROLE_TAGS = {
    "CLIENT": "wp_company_client",
    "CONTRACTOR": "wp_company_contractor",
    "SUPPLIER": "wp_company_supplier",
}
ROLES = (
    ("CLIENT", "Client", "Kunde/Auftraggeber"),
    ("CONTRACTOR", "Contractor", "Auftragnehmer/Dienstleister"),
    ("SUPPLIER", "Supplier", "Lieferant"),
)

HUB_COMPANY = HubSpec("hub_company", "hk_company", ("object_id", "source_table"))
HUB_COUNTRY = HubSpec("hub_country", "hk_country", ("object_id",))
HUB_PROJECT = HubSpec("hub_project", "hk_project", ("object_id",))
SAT_COMPANY = SatelliteSpec("sat_company", "hk_company", "hd_company", COMPANY_PAYLOAD)
SAT_COUNTRY = SatelliteSpec("sat_country", "hk_country", "hd_country", ("name",))
SAT_PROJECT = SatelliteSpec("sat_project", "hk_project", "hd_project", PROJECT_DIFF)
SAT_CLIENT_EXT = SatelliteSpec(
    "sat_company_client_ext", "hk_company", "hd_company_client_ext", ("freistellungsbescheinigung",)
)
LINK_ROLE = LinkSpec("link_company_role", "hk_link_company_role", ("hk_company", "hk_role"), ("role_code",))
LINK_COUNTRY = LinkSpec(
    "link_company_country", "hk_link_company_country", ("hk_company", "hk_country"), not_null=("country",)
)
EFF_COUNTRY = EffSatelliteSpec(
    "eff_sat_company_country", "hk_link_company_country", "hk_company", ("hk_company", "hk_country")
)

# Feeds disagree on the scale of the head count; all branches take the finer one.
_UNION_SCHEMA = T.StructType(
    [
        T.StructField(f.name, T.DecimalType(38, 18)) if f.name == "employeecount" else f
        for f in CLIENT_SCHEMA.fields
    ]
)


def company_union(feeds: Sequence[tuple[str, DataFrame]], extra: Sequence[T.StructField] = ()) -> DataFrame:
    """UNION ALL of (role, feed) pairs, tagged with role and source table."""
    schema = T.StructType([*_UNION_SCHEMA.fields, *extra])
    return union_sources(
        [Feed(df, {"role_code": role, "source_table": ROLE_TAGS[role]}) for role, df in feeds], schema
    )


def company_spec(
    default_source: str, now: str, encoding: str = "UTF-8", extra: Sequence[str] = ()
) -> StageSpec:
    """Staging of companies. With two-byte hashing the role key stays single-byte,
    as its source column is."""
    key = ("object_id", "source_table")
    return StageSpec(
        name="stg_company",
        keys={
            "hk_company": HashSpec(key, encoding=encoding),
            "hk_country": HashSpec(("country",), encoding=encoding),
            "hk_role": HashSpec(("role_code",)),
            "hk_link_company_role": HashSpec((*key, "role_code"), encoding=encoding),
            "hk_link_company_country": HashSpec((*key, "country"), encoding=encoding),
        },
        diffs={"hd_company": HashSpec(COMPANY_DIFF, "", encoding=encoding)},
        business_keys=(*key, "role_code"),
        payload=(*COMPANY_PAYLOAD, "freistellungsbescheinigung"),
        default_source=default_source,
        now=now,
        extra=extra,
    )


def country_spec(default_source: str, now: str, encoding: str = "UTF-8") -> StageSpec:
    return StageSpec(
        name="stg_country",
        keys={"hk_country": HashSpec(("object_id",), encoding=encoding)},
        diffs={"hd_country": HashSpec(("name",), "", encoding=encoding)},
        business_keys=("object_id",),
        payload=("name",),
        default_source=default_source,
        now=now,
    )


def project_spec(default_source: str, now: str, encoding: str = "UTF-8") -> StageSpec:
    return StageSpec(
        name="stg_project",
        keys={"hk_project": HashSpec(("object_id",), encoding=encoding)},
        diffs={"hd_project": HashSpec(PROJECT_DIFF, KEY_SEPARATOR, encoding=encoding)},
        business_keys=("object_id",),
        payload=PROJECT_DIFF,
        default_source=default_source,
        now=now,
    )


def stage_country(feed: DataFrame, spec: StageSpec) -> DataFrame:
    return stage(union_sources([Feed(feed)], COUNTRY_SCHEMA), spec)


def stage_project(feed: DataFrame, spec: StageSpec) -> DataFrame:
    return stage(union_sources([Feed(feed)], PROJECT_SCHEMA), spec)


def role_reference(spark: SparkSession, path: str) -> DataFrame:
    """The seed of company roles, three rows, kept as CSV at ``path``."""
    write_seed(spark.createDataFrame(list(ROLES), ROLE_SCHEMA), path)
    return read_seed(spark, path, ROLE_SCHEMA)


# -- marts ---------------------------------------------------------------------


def company_view(hub: DataFrame, sat: DataFrame, columns: Sequence[str]) -> DataFrame:
    return marts.mart(hub, "hk_company", [SatelliteSource("sat_company", sat, columns)])


def company_current(hub: DataFrame, sat: DataFrame) -> DataFrame:
    return company_view(hub, sat, ("name", "state", "org_type", "description"))


def company_current_flat(sat: DataFrame) -> DataFrame:
    """All attributes of the current versions, straight from the satellite, ghosts included."""
    shown = ("hk_company", *COMPANY_PAYLOAD, "hd_company", LOAD_DATE, RECORD_SOURCE, IS_CURRENT)
    return sat.where(F.col(IS_CURRENT) == "Y").select(*shown)


def country_view(hub: DataFrame, sat: DataFrame) -> DataFrame:
    return marts.mart(hub, "hk_country", [SatelliteSource("sat_country", sat, ("name",))])


def company_top3(hub: DataFrame, sat: DataFrame, limited: bool = False) -> DataFrame:
    """Flat view; ``limited`` also applies the order and limit its title promises."""
    view = company_view(hub, sat, TOP3_COLUMNS)
    return marts.top_n(view, [F.col("date_created").asc_nulls_last()], 3, "hk_company") if limited else view


def company_top5(hub: DataFrame, sat: DataFrame, limited: bool = False) -> DataFrame:
    view = company_view(hub, sat, TOP5_COLUMNS)
    return marts.top_n(view, [F.col("object_id").asc_nulls_last()], 5, "hk_company") if limited else view


def top10_customers(hub: DataFrame, sat: DataFrame, limited: bool = False) -> DataFrame:
    view = company_view(hub, sat, TOP10_COLUMNS)
    return marts.top_n(view, [F.col("date_created").asc_nulls_last()], 10, "hk_company") if limited else view


def company_extended(hub: DataFrame, sat: DataFrame, link: DataFrame, country: DataFrame) -> DataFrame:
    """Company with its country. A company with several country links repeats."""
    view = marts.mart(
        hub,
        "hk_company",
        [SatelliteSource("sat_company", sat, (*COMPANY_PAYLOAD, LOAD_DATE))],
        [LinkSource("link_company_country", link, "hk_country", SatelliteSource("sat_country", country, ("name", LOAD_DATE)))],
    )
    renamed = {
        "object_id": "company_id",
        "name": "company_name",
        "uid": "company_uid",
        "description": "company_description",
        "country": "country_code",
    }
    last = F.greatest(
        F.coalesce(LOAD_DATE, "hub_load_date"), F.coalesce(f"country_{LOAD_DATE}", "hub_load_date")
    ).alias("last_updated")
    kept = [c for c in view.columns if c not in (LOAD_DATE, f"country_{LOAD_DATE}", "hub_load_date")]
    return view.select(*[F.col(c).alias(renamed.get(c, c)) for c in kept], "hub_load_date", last)


def company_full(
    hub: DataFrame, sat: DataFrame, link_role: DataFrame, roles: DataFrame, link_country: DataFrame, country: DataFrame, many: bool = False
) -> DataFrame:
    """Company with role and country; companies without a current version are left out.
    ``many`` says that one company may own a large share of the links."""
    versions = sat.where(F.col(IS_CURRENT) == "Y").select(
        "hk_company",
        F.col("name").alias("company_name"),
        "street",
        F.col("citycode").alias("zip_code"),
        "city",
        F.col("country").alias("country_id"),
        "email", "phone", "mobile", "website", "iban", "bic", "credit_rating",
        F.col(LOAD_DATE).alias("last_updated"),
        F.col(RECORD_SOURCE).alias("source_system"),
    )
    countries = country.where(F.col(IS_CURRENT) == "Y").select("hk_country", F.col("name").alias("country_name"))
    keys = hub.where(F.col("object_id") > 0).select("hk_company", "object_id", "source_table")
    rows = keys.join(versions, ["hk_company"])
    rows = with_optional(rows, link_role.select("hk_company", "role_code"), ["hk_company"], many)
    rows = with_optional(rows, link_country.select("hk_company", "hk_country"), ["hk_company"], many)
    rows = with_optional(rows, roles.select("role_code", "role_name"), ["role_code"])
    return with_optional(rows, countries, ["hk_country"]).select(
        "hk_company", "object_id", "source_table", "company_name", "street", "zip_code", "city",
        "country_id", "country_name", "email", "phone", "mobile", "website", "iban", "bic",
        "credit_rating", "role_code", "role_name", "last_updated", "source_system",
    )


def companies_in(sat: DataFrame, link: DataFrame, country: DataFrame, name: str) -> DataFrame:
    return marts.in_target(sat, link, country, "hk_company", "hk_country", name, "country")


# -- the declared test suite -----------------------------------------------------


def _not_null(model: str, *columns: str) -> list[Check]:
    return [Check(model, c, "not_null") for c in columns]


# The declared checks that can bind to these tables.
CHECKS: tuple[Check, ...] = (
    *_not_null("stg_company", "hk_company", "hd_company", "object_id", "source_table", "role_code"),
    Check("stg_company", "role_code", "accepted_values", ("CLIENT", "CONTRACTOR", "SUPPLIER")),
    *_not_null("stg_country", "hk_country", "object_id"),
    *_not_null("hub_company", "hk_company", "object_id", "source_table", LOAD_DATE, RECORD_SOURCE),
    Check("hub_company", "hk_company", "unique"),
    *_not_null("hub_country", "hk_country", "object_id"),
    Check("hub_country", "hk_country", "unique"),
    *_not_null("sat_company", "hk_company", "hd_company"),
    Check("sat_company", "hk_company", "relationships", parent="hub_company", field="hk_company"),
    *_not_null("sat_country", "hk_country"),
    Check("sat_country", "hk_country", "relationships", parent="hub_country", field="hk_country"),
    *_not_null("sat_company_client_ext", "hk_company"),
    Check("sat_company_client_ext", "hk_company", "relationships", parent="hub_company", field="hk_company"),
    *_not_null("link_company_role", "hk_link_company_role", "hk_company", "hk_role", "role_code"),
    Check("link_company_role", "hk_link_company_role", "unique"),
    Check("link_company_role", "hk_company", "relationships", parent="hub_company", field="hk_company"),
    *_not_null("link_company_country", "hk_link_company_country", "hk_company", "hk_country"),
    Check("link_company_country", "hk_link_company_country", "unique"),
    Check("link_company_country", "hk_company", "relationships", parent="hub_company", field="hk_company"),
    Check("link_company_country", "hk_country", "relationships", parent="hub_country", field="hk_country"),
    *_not_null("v_company_top5", "object_id", "name", "hk_company"),
    Check("v_company_top5", "object_id", "unique"),
    Check("v_company_top5", "hk_company", "unique"),
    *_not_null("v_top10_customers", "hk_company", "object_id", "name", "date_created"),
    Check("v_top10_customers", "hk_company", "unique"),
    *_not_null("v_countries", "object_id", "name", "hk_country"),
    Check("v_countries", "object_id", "unique"),
    Check("v_countries", "hk_country", "unique"),
    *_not_null("v_company_current", "name", "state"),
    *_not_null("v_company_extended", "hk_company", "company_id", "company_name"),
    Check("v_company_extended", "hk_company", "unique"),
    Check("v_company_extended", "company_id", "unique"),
    *_not_null("ref_role", "role_code"),
    Check("ref_role", "role_code", "unique"),
    *_not_null("ext_company_client", "object_id"),
    *_not_null("ext_project", "object_id"),
)
