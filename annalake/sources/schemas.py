"""Declared schemas of the source feeds and the seed; never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns of the source feeds, in their declared order, with their types.
CLIENT_SCHEMA = T.StructType(
    [
        T.StructField("object_id", T.LongType()),
        T.StructField("date_created", T.TimestampNTZType()),
        T.StructField("date_updated", T.TimestampNTZType()),
        T.StructField("subscription", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("citycode", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("website", T.StringType()),
        T.StructField("street", T.StringType()),
        T.StructField("province", T.StringType()),
        T.StructField("credit_rating", T.StringType()),
        T.StructField("country", T.LongType()),
        T.StructField("employeecount", T.DecimalType(38, 0)),
        T.StructField("email", T.StringType()),
        T.StructField("commission_fee", T.StringType()),
        T.StructField("phone", T.StringType()),
        T.StructField("mobile", T.StringType()),
        T.StructField("mobile2", T.StringType()),
        T.StructField("bic", T.StringType()),
        T.StructField("fax", T.StringType()),
        T.StructField("iban", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("org_type", T.LongType()),
        T.StructField("uid", T.StringType()),
        T.StructField("freistellungsbescheinigung", T.TimestampNTZType()),
        T.StructField("dss_record_source", T.StringType()),
        T.StructField("dss_load_date", T.StringType()),
        T.StructField("dss_run_id", T.StringType()),
        T.StructField("dss_stage_timestamp", T.StringType()),
        T.StructField("dss_source_file_name", T.StringType()),
    ]
)
CONTRACTOR_SCHEMA = T.StructType(
    [
        T.StructField("object_id", T.LongType()),
        T.StructField("date_created", T.TimestampNTZType()),
        T.StructField("date_updated", T.TimestampNTZType()),
        T.StructField("subscription", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("citycode", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("website", T.StringType()),
        T.StructField("street", T.StringType()),
        T.StructField("province", T.StringType()),
        T.StructField("credit_rating", T.StringType()),
        T.StructField("country", T.LongType()),
        T.StructField("employeecount", T.DecimalType(38, 18)),
        T.StructField("email", T.StringType()),
        T.StructField("commission_fee", T.StringType()),
        T.StructField("phone", T.StringType()),
        T.StructField("mobile", T.StringType()),
        T.StructField("mobile2", T.StringType()),
        T.StructField("bic", T.StringType()),
        T.StructField("fax", T.StringType()),
        T.StructField("iban", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("org_type", T.LongType()),
        T.StructField("uid", T.StringType()),
        T.StructField("dss_record_source", T.StringType()),
        T.StructField("dss_load_date", T.StringType()),
        T.StructField("dss_run_id", T.StringType()),
        T.StructField("dss_stage_timestamp", T.StringType()),
        T.StructField("dss_source_file_name", T.StringType()),
    ]
)
SUPPLIER_SCHEMA = T.StructType(
    [
        T.StructField("object_id", T.LongType()),
        T.StructField("date_created", T.TimestampNTZType()),
        T.StructField("date_updated", T.TimestampNTZType()),
        T.StructField("subscription", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("citycode", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("website", T.StringType()),
        T.StructField("street", T.StringType()),
        T.StructField("province", T.StringType()),
        T.StructField("credit_rating", T.StringType()),
        T.StructField("country", T.LongType()),
        T.StructField("employeecount", T.DecimalType(38, 18)),
        T.StructField("email", T.StringType()),
        T.StructField("commission_fee", T.StringType()),
        T.StructField("phone", T.StringType()),
        T.StructField("mobile", T.StringType()),
        T.StructField("mobile2", T.StringType()),
        T.StructField("bic", T.StringType()),
        T.StructField("fax", T.StringType()),
        T.StructField("iban", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("org_type", T.LongType()),
        T.StructField("uid", T.StringType()),
        T.StructField("dss_record_source", T.StringType()),
        T.StructField("dss_load_date", T.StringType()),
        T.StructField("dss_run_id", T.StringType()),
        T.StructField("dss_stage_timestamp", T.StringType()),
        T.StructField("dss_source_file_name", T.StringType()),
    ]
)
COUNTRY_SCHEMA = T.StructType(
    [
        T.StructField("object_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("dss_record_source", T.StringType()),
        T.StructField("dss_load_date", T.StringType()),
        T.StructField("dss_run_id", T.StringType()),
    ]
)
PROJECT_SCHEMA = T.StructType(
    [
        T.StructField("object_id", T.LongType()),
        T.StructField("user_created", T.StringType()),
        T.StructField("date_created", T.TimestampNTZType()),
        T.StructField("user_updated", T.StringType()),
        T.StructField("date_updated", T.TimestampNTZType()),
        T.StructField("subscription", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("begin", T.TimestampNTZType()),
        T.StructField("location", T.StringType()),
        T.StructField("price", T.DecimalType(38, 18)),
        T.StructField("commission", T.DecimalType(38, 18)),
        T.StructField("end", T.TimestampNTZType()),
        T.StructField("work_begin", T.StringType()),
        T.StructField("author_email", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("price_units_value", T.StringType()),
        T.StructField("commission_units_value", T.StringType()),
        T.StructField("details", T.StringType()),
        T.StructField("user", T.LongType()),
        T.StructField("provision_charged_state", T.StringType()),
        T.StructField("contractor_count", T.IntegerType()),
        T.StructField("client", T.LongType()),
        T.StructField("contractor", T.LongType()),
        T.StructField("member", T.StringType()),
        T.StructField("hidden", T.BooleanType()),
        T.StructField("is_contracting", T.BooleanType()),
        T.StructField("dss_record_source", T.StringType()),
        T.StructField("dss_load_date", T.StringType()),
        T.StructField("dss_run_id", T.StringType()),
        T.StructField("dss_stage_timestamp", T.StringType()),
        T.StructField("dss_source_file_name", T.StringType()),
    ]
)
ROLE_SCHEMA = T.StructType(
    [
        T.StructField("role_code", T.StringType()),
        T.StructField("role_name", T.StringType()),
        T.StructField("role_description", T.StringType()),
    ]
)
