"""Append-only and versioned Parquet tables, and published views.

A table is a folder. Appends go to ``load_id=<n>`` and rewrite exactly that
folder, so a load repeated after a failure replaces its own rows instead of
adding them twice. Full rebuilds go to ``version=<n>``; readers follow the
highest version whose ``_SUCCESS`` marker is present, so a rebuild that died
half-way is never read and the previous version stays valid meanwhile. Many loads
can be folded into one ``compacted=<n>`` folder in the same way.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalake.session import shared_dir

# Column that tells the folded loads apart.
_LOAD = "_load_id"
# Bytes of a file of folded loads, about.
FILE_SIZE = 64 << 20


def _file_system(spark: SparkSession, path: str, act: Callable[[Any, Any], Any]) -> Any:
    """``act`` on a path and the file system it points to."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return act(folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder)


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder."""

    def names(fs: Any, folder: Any) -> list[str]:
        return [status.getPath().getName() for status in fs.listStatus(folder)] if fs.exists(folder) else []

    return _file_system(spark, path, names)


def _numbers(names: list[str], label: str) -> list[int]:
    return sorted(int(m.group(1)) for m in (re.fullmatch(rf"{label}=(\d+)", n) for n in names) if m)


def _reader(spark: SparkSession, schema: T.StructType | None) -> DataFrameReader:
    """With a known schema no job has to look for one."""
    return spark.read if schema is None else spark.read.schema(schema)


def write_append(df: DataFrame, table: str, load_id: int) -> None:
    """Append one load; repeating the same ``load_id`` is idempotent."""
    folded = _complete(df.sparkSession, table, "compacted")
    if folded and load_id <= folded[-1]:
        raise ValueError(f"load {load_id} of {table} is folded already")
    df.write.mode("overwrite").parquet(f"{table}/load_id={load_id}")


def read_appended(
    spark: SparkSession, table: str, before: int | None = None, schema: T.StructType | None = None
) -> DataFrame | None:
    """All loads (those before ``before``), or None when there are none yet."""
    names = _children(spark, table)
    folded = _complete(spark, table, "compacted", names)
    upto = folded[-1] if folded else -1
    loads = [n for n in _numbers(names, "load_id") if n > upto and (before is None or n < before)]
    parts = []
    if folded:
        own = None if schema is None else T.StructType([*schema.fields, T.StructField(_LOAD, T.LongType())])
        rows = _reader(spark, own).parquet(f"{table}/compacted={upto}")
        parts.append((rows if before is None or before > upto else rows.where(F.col(_LOAD) < before)).drop(_LOAD))
    if loads:
        parts.append(_reader(spark, schema).parquet(*[f"{table}/load_id={n}" for n in loads]))
    return reduce(DataFrame.unionByName, parts) if parts else None


def _folding(spark: SparkSession, table: str, loads: list[int], folded: int | None) -> DataFrame:
    """Rows of load folders and of a folded one, in one scan without a shuffle and as
    many partitions as files of ``FILE_SIZE`` take."""

    def size(fs: Any, folder: Any) -> int:
        return fs.getContentSummary(folder).getLength()

    paths = [f"{table}/load_id={n}" for n in loads]
    number = F.regexp_extract("_metadata.file_path", r"/load_id=(\d+)/[^/]*$", 1).cast("bigint")
    rows = spark.read.parquet(*paths).withColumn(_LOAD, number)
    if folded is not None:
        paths.append(f"{table}/compacted={folded}")
        rows = rows.unionByName(spark.read.parquet(paths[-1]))
    return rows.coalesce(1 + sum(_file_system(spark, path, size) for path in paths) // FILE_SIZE)


def compact(spark: SparkSession, table: str, upto: int) -> None:
    """Fold all loads up to number ``upto`` into one folder.

    Readers take the folded loads from the newest complete folder and only later
    loads from their own, so a row is seen once whether this ends or dies at any
    step. What a folder replaces goes when the next one is complete, which leaves
    running readers as much time. A folded load can't be repeated.
    """
    folded = _complete(spark, table, "compacted")
    if folded and upto <= folded[-1]:
        return
    last = folded[-1] if folded else -1
    loads = [n for n in _numbers(_children(spark, table), "load_id") if last < n <= upto]
    if loads:
        rows = _folding(spark, table, loads, last if folded else None)
        rows.write.mode("overwrite").parquet(f"{table}/compacted={upto}")
    for name in _children(spark, table):
        label, _, number = name.partition("=")
        if number.isdigit() and ((label == "load_id" and int(number) <= last) or (label == "compacted" and int(number) < last)):
            _file_system(spark, f"{table}/{name}", lambda fs, path: fs.delete(path, True))


def partitions(spark: SparkSession, table: str, column: str) -> list[str]:
    """Values of a partition column, from the names of folders."""
    label = f"{column}="
    return sorted(n.removeprefix(label) for n in _children(spark, table) if n.startswith(label))


def _complete(spark: SparkSession, table: str, label: str, names: list[str] | None = None) -> list[int]:
    """Numbers of the complete folders with a label."""
    numbers = _numbers(_children(spark, table) if names is None else names, label)
    return [n for n in numbers if "_SUCCESS" in _children(spark, f"{table}/{label}={n}")]


def _complete_versions(spark: SparkSession, table: str) -> list[int]:
    return _complete(spark, table, "version")


def write_overwrite(
    df: DataFrame, table: str, partition_by: list[str] | None = None, version: int | None = None
) -> int:
    """Full rebuild into a new version (or a given one); returns its number."""
    if version is None:
        taken = _numbers(_children(df.sparkSession, table), "version")
        version = taken[-1] + 1 if taken else 0
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{table}/version={version}")
    return version


def read_current(
    spark: SparkSession, table: str, before: int | None = None, schema: T.StructType | None = None
) -> DataFrame | None:
    """The latest complete version (older than ``before``), or None."""
    versions = [v for v in _complete_versions(spark, table) if before is None or v < before]
    if not versions:
        return None
    return _reader(spark, schema).parquet(f"{table}/version={versions[-1]}")


def drop_versions(spark: SparkSession, table: str, keep: int = 2) -> None:
    """Remove all but the newest complete versions and what is left of failed ones
    before them. With two kept, a reader of the version before a rebuild can finish."""
    complete = _complete_versions(spark, table)
    for version in _numbers(_children(spark, table), "version"):
        if len(complete) >= keep and version < complete[-keep]:
            _file_system(spark, f"{table}/version={version}", lambda fs, path: fs.delete(path, True))


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/annalake/{uuid.uuid4().hex}"


def write_once(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows on shared storage: computed once however often they are read, and
    not again when executors are lost."""
    path = folder or scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def current_path(spark: SparkSession, table: str) -> str:
    """Folder of the latest complete version."""
    return f"{table}/version={_complete_versions(spark, table)[-1]}"


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> None:
    """Catalog table bucketed and sorted by its hash key, in the warehouse or at a path.

    Hub, satellite and link tables bucketed alike join on the key without a
    shuffle, which is what repeated mart queries at scale want. Rows are dealt
    by the key first, so a bucket is one file.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer if path is None else writer.option("path", path)).saveAsTable(name)


def view_name(schema: str | None, name: str, default: str | None = None) -> str:
    """The custom schema verbatim (trimmed); the target's default without one."""
    namespace = schema.strip() if schema else default
    return f"{namespace}.{name}" if namespace else name


def publish_view(df: DataFrame, name: str) -> str:
    """Session view over a lazy DataFrame."""
    df.createOrReplaceTempView(name)
    return name


def publish_sql_view(spark: SparkSession, query: str, name: str, schema: str | None = None) -> str:
    """Catalog view under an unprefixed schema."""
    full = view_name(schema, name)
    if schema:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema.strip()}")
    spark.sql(f"CREATE OR REPLACE VIEW {full} AS {query}")
    return full


def drop_views(spark: SparkSession, names: list[str]) -> None:
    """Drop obsolete views; absent ones are no error."""
    for name in names:
        namespace, _, _view = name.rpartition(".")
        if namespace and not spark.catalog.databaseExists(namespace):
            continue
        spark.sql(f"DROP VIEW IF EXISTS {name}")
