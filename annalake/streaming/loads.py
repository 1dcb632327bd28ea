"""Vault loads driven by a stream of feed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from annalake.plans.batches import Vault


def feed_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as they arrive below a path."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_loads(
    feed: DataFrame, stage: Callable[[DataFrame], DataFrame], vault: Vault, checkpoint: str
) -> StreamingQuery:
    """Load every micro-batch into the vault.

    The micro-batch number is the load number: a batch repeated after a
    failure rewrites its own folder, which makes the sink exactly-once.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        vault.load(stage(batch), batch_id)

    return (
        feed.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
