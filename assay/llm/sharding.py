"""Rendezvous (highest random weight) sharding of record keys over weighted shards.

Shard s of weight w scores a key with ``-w / ln(u)``, u a hash of (key, s) in (0, 1); the
highest score wins.  Scores of old shards don't depend on how many shards there are, so a
new shard only takes keys into itself, in proportion to its weight.

Slots number a shard's records without gaps.  No shard is gathered anywhere: each task
numbers its own records per shard with one counter a shard, counts per (task, shard) are
summed up in task order, and a record's slot is its number plus the sum before its task.

Cases: records with a null key go where the key "null" goes; null texts count 8 bytes and
checksum 0; repeated keys share a shard and get slots of their own; equal scores (never
seen with 53 bits) go to the larger shard; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.common import column, extended, text_or_empty, written

SHARDS = 24
ROW_OVERHEAD = 8


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard number of a key among ``len(weights)`` shards of positive weight."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    name = F.coalesce(key.cast("string"), F.lit("null"))

    def score(shard: int, weight: float) -> Column:
        # 53 bits of the hash, moved off 0 and 1
        u = (F.shiftrightunsigned(F.xxhash64(name, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.lit(float(weight)) / F.log(u)).alias("score"), F.lit(shard).alias("shard"))

    return F.array_max(F.array(*(score(s, w) for s, w in enumerate(weights))))["shard"]


def number_slots(df: DataFrame, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """Add gapless slots from 0 per shard."""
    fields = [f for f in df.schema.fields if f.name not in (slot_col, "_task")]
    schema = T.StructType([*fields, T.StructField("_task", T.IntegerType()), T.StructField(slot_col, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, counts = TaskContext.get().partitionId(), {}
        for batch in batches:
            shards = pd.Series(column(batch, shard_col).to_numpy(zero_copy_only=False))
            at = shards.groupby(shards).cumcount() + shards.map(counts).fillna(0).astype("int64")
            for s, n in shards.value_counts().items():
                counts[s] = counts.get(s, 0) + n
            yield extended(batch, [f.name for f in fields], {
                "_task": pa.array([task] * len(shards), pa.int32()), slot_col: pa.array(at.to_numpy(), pa.int64())})

    own = written(df.select(*(f.name for f in fields)).mapInArrow(run, schema), "shards")
    counts = own.groupBy(shard_col, "_task").agg((F.max(slot_col) + 1).alias("_n"))
    before = Window.partitionBy(shard_col).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(shard_col, "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    joined = own.join(first, [shard_col, "_task"])
    return joined.select(*(f.name for f in fields), (F.col(slot_col) + F.col("_first")).alias(slot_col))


def shard_documents(docs: DataFrame, shards: int = SHARDS, weights: Sequence[float] | None = None,
                    grown_weight: float = 1.0) -> DataFrame:
    """The contract's rows: shard, slot and the shard after one more shard has joined."""
    weights = list(weights or [1.0] * shards)
    text = text_or_empty()
    rows = docs.select(
        "doc_id", (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"), rendezvous(F.col("doc_id"), weights).alias("shard"),
        rendezvous(F.col("doc_id"), [*weights, grown_weight]).alias("grown_shard"))
    return number_slots(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
