"""Loads whose memory is Spark's state store.

A micro-batch reads no earlier load: what a load has to know is kept as keyed
state, which Spark partitions by key, writes to the checkpoint with every
micro-batch and restores after a failure. A hub or link keeps each key it has, a
satellite each (key, diff), as 32 bytes of SHA-256 in one of ``BUCKETS`` states: a
call of Python costs far more than a row, so it serves a bucket and not a key. A
satellite that compares with the newest version keeps, by key, the newest load date
and the diffs it has there. Rows reach Python in Arrow batches, so a hot key costs
time in one task but no memory; the state of a key is bounded by its ties, that of a
bucket by its share of all keys.

Every micro-batch is written to its own load folder, so one that is repeated
after a failure replaces its rows. The result equals that of ``Vault.load`` on
the same batches. The RocksDB state store (``spark.sql.streaming.stateStore.
providerClass``) keeps large states off the executors' heap.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from annalake.operators.loads import open_version
from annalake.sources import sinks
from annalake.specs import LOAD_DATE, RECORD_SOURCE, SatelliteSpec

# The helpers travel with the task, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_JSON = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}
#: Stands for a row without a load date, which is never the newest.
_NEVER = -(1 << 52)
#: States that share the keys; a checkpoint depends on their number.
BUCKETS = 1024
_WIDTH = 32


def _unseen(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """All rows of each key's first micro-batch."""
    kept = bytes(state.get[0]) if state.exists else b""
    known, added = {kept[i : i + _WIDTH] for i in range(0, len(kept), _WIDTH)}, set()
    for part in parts:
        ids = [bytes(i) for i in part["_id"]]
        new = [i not in known for i in ids]
        added.update(i for i, is_new in zip(ids, new) if is_new)
        yield part.loc[new, ["_row"]]
    if added:
        state.update((kept + b"".join(added),))


def _changed(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows whose diff isn't among the key's newest ones, which then are replaced or joined."""
    newest, known = (state.get[0], set(state.get[1])) if state.exists else (_NEVER, set())
    top, added = _NEVER, set()
    for part in parts:
        new = part[~part["_value"].isin(known)]
        dated = new[new["_at"] > _NEVER]
        if len(dated):
            at = int(dated["_at"].max())
            if at >= top:
                here = set(dated.loc[dated["_at"] == at, "_value"])
                top, added = at, (added | here if at == top else here)
        yield new[["_row"]]
    if added and top >= newest:
        state.update((top, sorted(known | added if top == newest else added)))


def _load(rows: DataFrame, keys: Sequence[str], finish: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, value: str | None = None) -> StreamingQuery:
    """Rows travel as text beside what the step looks at: pandas would change types."""
    if value:
        step, state = _changed, "newest long, known array<string>"
        at = F.unix_micros(F.col(LOAD_DATE).cast("timestamp"))
        columns: dict[str, Column] = {f"_key{i}": F.col(k).cast("string") for i, k in enumerate(keys)}
        groups = [*columns]
        columns |= {"_value": F.col(value).cast("string"), "_at": F.coalesce(at, F.lit(_NEVER))}
    else:
        step, state = _unseen, "seen binary"
        text = F.to_json(F.struct(*[F.col(k).cast("string").alias(f"_key{i}") for i, k in enumerate(keys)]), _JSON)
        identity, groups = F.unhex(F.sha2(text, 256)), ["_bucket"]
        columns = {"_bucket": F.pmod(F.xxhash64(identity), F.lit(BUCKETS)).cast("int"), "_id": identity}
    packed = rows.select(*[c.alias(n) for n, c in columns.items()], F.to_json(F.struct(*[f"`{c}`" for c in rows.columns]), _JSON).alias("_row"))
    out = T.StructType([T.StructField("_row", T.StringType())])
    kept = packed.groupBy(*groups).applyInPandasWithState(step, out, state, "append", "NoTimeout")
    given = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
    unpacked = kept.select(F.from_json("_row", given, _JSON).alias("_row")).select("_row.*")

    def apply(batch: DataFrame, batch_id: int) -> None:
        sinks.write_append(finish(batch), table, batch_id)

    return unpacked.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_keys(staged: DataFrame, keys: Sequence[str], columns: Sequence[str], table: str, checkpoint: str, not_null: Sequence[str] = ()) -> StreamingQuery:
    """A hub or link: the distinct rows of the first micro-batch that has their key.
    ``columns`` come with load date and source, ``not_null`` must be given besides the keys."""
    rows = staged.dropna(subset=[*keys, *not_null]).select(*dict.fromkeys([*keys, *columns]), LOAD_DATE, RECORD_SOURCE)
    return _load(rows, keys, DataFrame.distinct, table, checkpoint)


def stream_versions(staged: DataFrame, sat: SatelliteSpec, table: str, checkpoint: str) -> StreamingQuery:
    """A satellite, open: what ``load_satellite`` adds for every micro-batch."""
    rows = staged.where(F.col(sat.hk).isNotNull()).select(sat.hk, sat.hd, LOAD_DATE, RECORD_SOURCE, *[f"`{c}`" for c in sat.payload])
    if sat.compare == "any":
        return _load(rows, [sat.hk, sat.hd], open_version, table, checkpoint)
    return _load(rows, [sat.hk], open_version, table, checkpoint, sat.hd)
