"""Hash text, sentinel keys and encodings, against digests computed by hashlib."""

import datetime
import hashlib
from decimal import Decimal

from pyspark.sql import functions as F

from annalake.functions import hashing
from annalake.operators.staging import derived_columns, load_metadata
from annalake.specs import HubSpec, LinkSpec, SatelliteSpec, StageSpec

import pytest


def sha(text, encoding="utf-8"):
    return hashlib.sha256(text.encode(encoding)).hexdigest().upper()


def test_null_key_hashes_as_empty_text(spark):
    df = spark.createDataFrame([(None, "a"), (7, None)], "id bigint, code string")
    rows = df.select(hashing.hash_key(df, "id").alias("one"), hashing.hash_key(df, ["id", "code"]).alias("two")).collect()
    assert rows[0].one == sha("") == "E3B0C44298FC1C149AFBF4C8996FB92427AE41E4649B934CA495991B7852B855"
    assert rows[0].two == sha("^^a")
    assert rows[1].two == sha("7^^")


def test_diff_without_separator_collides_and_with_separator_does_not(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc")], "x string, y string")
    plain = {r[0] for r in df.select(hashing.hash_diff(df, ["x", "y"])).collect()}
    separated = {r[0] for r in df.select(hashing.hash_diff(df, ["x", "y"], sep="^^")).collect()}
    assert plain == {sha("abc")}
    assert separated == {sha("ab^^c"), sha("a^^bc")}


def test_two_byte_encoding_and_md5(spark):
    df = spark.createDataFrame([("Müller €\U0001f600",)], "name string")
    row = df.select(
        hashing.hash_key(df, "name", encoding="UTF-16LE").alias("wide"),
        hashing.hash_key(df, "name", algorithm="MD5").alias("md5"),
    ).first()
    assert row.wide == sha("Müller €\U0001f600", "utf-16-le")
    assert row.md5 == hashlib.md5("Müller €\U0001f600".encode()).hexdigest().upper()


def test_rendering_of_numbers_times_and_flags(spark):
    moment = datetime.datetime(2024, 1, 2, 3, 4, 5, 60)
    df = spark.createDataFrame(
        [(1e10, Decimal("1.5"), moment, True, Decimal(0))],
        "d double, n decimal(38,18), t timestamp_ntz, b boolean, z decimal(38,18)",
    )
    texts = df.select(*[hashing.text_of(df, c).alias(c) for c in df.columns]).first()
    assert texts.asDict() == {
        "d": "1.0E10",
        "n": "1.500000000000000000",
        "t": "2024-01-02 03:04:05.000060",
        "b": "1",
        "z": "0.000000000000000000",
    }


def test_doubles_hash_in_full(spark):
    df = spark.createDataFrame([(0.001,), (0.004,), (1e17,), (0.1 + 0.2,), (0.3,)], "d double")
    assert df.select(hashing.hash_diff(df, ["d"]).alias("h")).distinct().count() == 5


def test_resolve_key(spark):
    df = spark.createDataFrame([(None,), (5,), (99,)], "id bigint")
    keys = df.select(hashing.resolve_key(F.col("id"), F.col("id") < 10, hashing.hash_key(df, "id")).alias("k"))
    assert [r.k for r in keys.collect()] == [hashing.ZERO_KEY, sha("5"), hashing.ERROR_KEY]


def test_unknown_options_are_refused(spark):
    df = spark.createDataFrame([(1,)], "id bigint")
    with pytest.raises(ValueError):
        hashing.hash_key(df, "id", algorithm="CRC")
    with pytest.raises(ValueError):
        hashing.hash_key(df, "id", encoding="latin")
    with pytest.raises(ValueError):
        hashing.link_hash_key(df, ["id"])


def test_load_metadata_defaults(spark):
    df = spark.createDataFrame(
        [(None, "2024-01-05 06:00:00"), ("crm", "bad"), ("crm", None)], "dss_record_source string, dss_load_date string"
    )
    rows = load_metadata(df, "portal", "2024-02-01 00:00:00").collect()
    now = datetime.datetime(2024, 2, 1)
    assert [(r.dss_record_source, r.dss_load_date) for r in rows] == [
        ("portal", datetime.datetime(2024, 1, 5, 6)),
        ("crm", now),
        ("crm", now),
    ]


def test_derived_columns(spark):
    df = spark.createDataFrame([(2,)], "n int")
    row = derived_columns(df, {"source": "!CRM", "double": "n * 2"}).first()
    assert (row.source, row.double) == ("CRM", 4)


def test_specs_enforce_naming():
    with pytest.raises(ValueError):
        HubSpec("company", "hk_company", ("object_id",))
    with pytest.raises(ValueError):
        LinkSpec("link_a", "hk_link_a", ("hk_a",))
    with pytest.raises(ValueError):
        SatelliteSpec("sat_x", "company", "hd_x", ())
    with pytest.raises(ValueError):
        StageSpec("company", {}, {}, (), (), "portal", "2024-01-01")
    with pytest.warns(UserWarning):
        HubSpec("hub_company", "hk_company", ("shortname",))
