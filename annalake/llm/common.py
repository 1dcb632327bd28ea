"""What the operators share: input columns, the learning split, scratch tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalake.session import shared_dir, tune

#: Rows and bytes of one Arrow batch; a batch is what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names: other columns can't clash."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from. A NULL id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that all executors share."""
    return f"{shared_dir(spark)}/llm/{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write once, read many times; survives the loss of executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_batch(columns: dict[str, object], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in types.items()], names=list(types))


def row_slices(batches: Iterable[pa.RecordBatch], text_col: str = "text", limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The same rows in slices of about ``limit`` bytes of text, one row at
    least, and their texts with the empty text where one is NULL."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text_col)).fill_null("")
        start, size = 0, 0
        lengths = pc.binary_length(texts).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and size + n > limit:
                yield batch.slice(start, i - start), texts.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < len(lengths):
            yield batch.slice(start), texts.slice(start)


def text_slices(batches: Iterable[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices as of ``row_slices``, with those texts as column ``text``."""
    for batch, texts in row_slices(batches, "text", limit):
        yield batch.set_column(batch.schema.get_field_index("text"), "text", texts)


def kept_rows(docs: DataFrame, text_col: str, keep: Callable[[pa.Array], np.ndarray], limit: int = 1 << 20) -> DataFrame:
    """Whole rows of ``docs`` where ``keep`` of their texts is true, without a shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in row_slices(batches, text_col, limit):
            yield batch.filter(pa.array(keep(texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
