"""The driver contract."""

import inspect

import duckdb
import pytest

import __spark_entry__ as entry
import compare
from annalake.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
# One or two queries per family; compare.py runs them all.
FAMILIES = (
    "stage_company", "stage_project", "hash_key_utf16", "hub_incremental", "link_company_country", "sat_company",
    "sat_two_batch", "sat_closed_ties", "eff_closed", "ghost_sat", "pit_user", "pit_multi", "mart_company_extended",
    "check_relationships", "chunk_metadata", "incremental_reindex", "similar_topk", "upsert", "latest_status",
)


def test_entry_runs_and_keeps_its_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["hk_company", "object_id", "name", "state", "org_type", "description", "hub_load_date"]
    assert df.count() > 0


def test_every_query_has_its_sql():
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_take_session_and_folder():
    for run in entry.queries().values():
        assert list(inspect.signature(run).parameters) == ["spark", "sf_dir"]


@pytest.mark.parametrize("name", FAMILIES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in compare.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    df = entry.queries()[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(columns)
    assert compare.rows_of(df.columns, df.collect()) == compare.rows_of(columns, result.fetchall())


@pytest.mark.parametrize("name", ["ghost_hub", "pit_multi", "mart_company_full", "similar_topk", "companies_in_country"])
def test_no_nested_loops(spark, name):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
