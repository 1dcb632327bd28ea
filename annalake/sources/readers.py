"""Fixed-schema scans: Parquet feeds and CSV reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_source(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet scan; with a declared schema the reader neither infers nor merges."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_seed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV reference table with a header line and regular CSV quoting."""
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', mode="FAILFAST")


def write_seed(df: DataFrame, path: str) -> None:
    """Write a reference table so that ``read_seed`` returns the same rows."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: cast present columns, typed NULL for absent ones."""
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
