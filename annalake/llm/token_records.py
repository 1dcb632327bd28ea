"""Token ids as length-delimited binary records, with a separate offset index.

A file is a sequence of frames:

    8 bytes   length of the payload, little-endian
    4 bytes   masked CRC-32 of these 8 bytes
    payload   flags (1 byte), id of the document (8 bytes), token ids
    4 bytes   masked CRC-32 of the payload
    1 byte    0x0A

Flags: the bytes of one token id (2 or 4), plus 128 where the document has no
id. A mask keeps checksums of data that hold checksums apart: rotate right by 15
bits, add 0xA282EAD8. Spark's own text writer puts the frames into files, so they
are committed like any table, to any file system; the binary file reader reads
them back. The index has a row for each record: file, record, offset, length.

Texts are encoded in pieces: a blank before anything but white space always
begins a new token of a byte-level BPE, so pieces between such blanks encode on
their own. A task encodes each different piece once and keeps the ids.

Defined results: a NULL text counts as empty and has the end id alone. Records
are in ascending order of id, NULL ids first; rows that share an id are ordered
by a hash of their text. Texts are taken whole, whatever their length.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annalake.llm.common import arrow_batch, scratch, stored, text_slices, texts_of
from annalake.llm.pieces import PieceCache

_NO_ID = 128
_HEAD = struct.Struct("<QI")
_TAIL = struct.Struct("<IB")
_OWNER = struct.Struct("<Bq")
_SPACE_OR_UNSURE = np.zeros(256, bool)
_SPACE_OR_UNSURE[[*range(33), 127, 0xC2, 0xE1, 0xE2, 0xE3]] = True  # first bytes of white space outside ASCII


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """Without the last byte, which the writer adds."""
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def frames(data: bytes | memoryview) -> Iterator[tuple[int, memoryview]]:
    """Offset and payload of each frame; raises where a checksum or a length is wrong."""
    view, at = memoryview(data), 0
    while at < len(view):
        yield at, (payload := read_frame(view, at))
        at += _HEAD.size + len(payload) + _TAIL.size


def read_frame(view: memoryview, at: int) -> memoryview:
    if len(view) < at + _HEAD.size:
        raise ValueError(f"a frame at {at} is cut off")
    length, crc = _HEAD.unpack_from(view, at)
    if masked(bytes(view[at : at + 8])) != crc:
        raise ValueError(f"wrong checksum of the length at {at}")
    start = at + _HEAD.size
    if len(view) < start + length + _TAIL.size:
        raise ValueError(f"a frame at {at} is cut off")
    payload = view[start : start + length]
    crc, end = _TAIL.unpack_from(view, start + length)
    if masked(bytes(payload)) != crc or end != 10:
        raise ValueError(f"wrong checksum of the payload at {at}")
    return payload


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = ids.dtype.itemsize
    return _OWNER.pack(width | (_NO_ID if doc_id is None else 0), doc_id or 0) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: memoryview) -> tuple[int | None, np.ndarray]:
    flags, doc_id = _OWNER.unpack_from(payload)
    ids = np.frombuffer(payload[_OWNER.size :], f"<u{flags & 127}").astype("<u4")
    return (None if flags & _NO_ID else doc_id), ids


class PieceEncoder(PieceCache):
    """Encodes texts by a byte-level BPE of the tokenizers library."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        super().__init__(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)

    def begins(self, data: np.ndarray, final: np.ndarray) -> np.ndarray:
        """Parts begin with a blank that stands before anything but white space."""
        found = np.zeros(len(data), bool)
        found[:-1] = (data[:-1] == 32) & ~_SPACE_OR_UNSURE[data[1:]]
        return found & ~final

    def ids_of(self, parts: list[str], at_start: list[bool]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One for each Python worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write the frames below ``folder``, in ascending order of id."""

    def framed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        end = np.array([end_id], own.dtype)
        for batch in text_slices(batches):
            ids, bounds = own.encode(batch.column("text"))
            out = [frame(pack(doc, np.concatenate([ids[a:b], end]))) for doc, a, b in zip(batch.column("doc_id").to_pylist(), bounds[:-1], bounds[1:], strict=True)]
            yield arrow_batch({"frame": out}, {"frame": pa.binary()})

    rows = texts_of(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows.select("doc_id", "text").mapInArrow(framed, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(folder)


def _part() -> F.Column:
    return F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"part-(\d+)", 1).cast("int")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record, from the files: file (their number in order),
    record, offset, length, doc_id, before (ids before it in the file), n_tokens, ids_crc32."""
    types = {"file": pa.int32(), "record": pa.int64(), "offset": pa.int64(), "length": pa.int64(), "doc_id": pa.int64(), "before": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                rows, before = [], 0
                for record, (offset, payload) in enumerate(frames(content.as_buffer())):
                    doc_id, ids = unpack(payload)
                    rows.append((file, record, offset, len(payload), doc_id, before, len(ids), zlib.crc32(ids.tobytes())))
                    before += len(ids)
                columns = zip(*rows, strict=True) if rows else [[]] * len(types)
                yield arrow_batch(dict(zip(types, map(list, columns), strict=True)), types)

    files = spark.read.format("binaryFile").load(folder).select(_part().alias("file"), "content")
    return files.mapInArrow(scan, "file int, record long, offset long, length long, doc_id long, before long, n_tokens long, ids_crc32 long")


def read_shuffled(spark: SparkSession, folder: str, index: DataFrame, seed: int) -> DataFrame:
    """position (a random number), doc_id and ids of the records in ``index``, in random order.
    Each file is opened once, with the offsets that are wanted of it."""
    wanted = index.select("file", "offset").groupBy("file").agg(F.collect_list("offset").alias("offsets"))
    files = spark.read.format("binaryFile").load(folder).select(_part().alias("file"), "content").join(wanted, "file")

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, offsets in zip(batch.column("content"), batch.column("offsets").to_pylist(), strict=True):
                view = memoryview(content.as_buffer())
                for at in offsets:
                    doc_id, ids = unpack(read_frame(view, at))
                    yield arrow_batch({"doc_id": [doc_id], "ids": [ids.tolist()]}, {"doc_id": pa.int64(), "ids": pa.list_(pa.int64())})

    found = files.select("content", "offsets").mapInArrow(fetch, "doc_id long, ids array<long>")
    return found.withColumn("position", F.xxhash64("doc_id", F.lit(seed))).orderBy("position", "doc_id")


def token_records(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write records and index below ``folder`` and return, as read back, a row
    for each document: doc_id, start, n_tokens, ids_crc32, file, offset, length."""
    spark = docs.sparkSession
    folder = folder or scratch(spark)
    write_records(docs, f"{folder}/records", tokenizer, end_id, id_col, text_col)
    index = stored(read_index(spark, f"{folder}/records"), f"{folder}/index")
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    starts = totals.select("file", (F.sum("total").over(W.orderBy("file")) - F.col("total")).alias("first"))  # a row for each file
    placed = index.join(starts, "file")
    return placed.select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "file", "offset", "length")
