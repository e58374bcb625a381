"""Shards by jump consistent hashing of a stable key.

A key and the number of shards decide; growing from n to n + 1 shards moves about one row in n + 1, all of
them into the new shard. No ring table is kept.

Places within a shard are gapless without a task that sees a whole shard: rows are counted by (shard,
chunk), chunks get offsets, and rows are numbered within their chunk.

Defined results: a null text has no bytes; null keys share one shard; repeated rows take places of their
own; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Scratch

#: Multiplier and shift of the published algorithm's generator.
MULTIPLIER = np.uint64(2862933555777941757)
#: Rows of a chunk, in expectation.
CHUNK_ROWS = 50_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key, for all keys at once."""
    if shards < 1:
        raise ValueError("at least one shard")
    state = keys.astype(np.uint64)
    at = np.full(len(state), -1, dtype=np.int64)
    ahead = np.zeros(len(state), dtype=np.int64)
    open_ = ahead < shards
    with np.errstate(over="ignore"):
        while open_.any():
            at = np.where(open_, ahead, at)
            state = np.where(open_, state * MULTIPLIER + np.uint64(1), state)
            draw = ((state >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
            ahead = np.where(open_, ((at + 1) * (float(1 << 31) / draw)).astype(np.int64), ahead)
            open_ = ahead < shards
    return at


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def place(h: pd.Series) -> pd.Series:
        return pd.Series(jump(h.to_numpy(dtype=np.int64).view(np.uint64), shards).astype(np.int32))

    return place(F.xxhash64(key))


def assign(docs: DataFrame, shards: int = 16, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``."""
    scratch = scratch or Scratch(docs.sparkSession)
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    placed = rows.withColumns({"shard": shard_of(F.col("doc_id"), shards), "grown_shard": shard_of(F.col("doc_id"), shards + 1)})
    # written, so that rows keep their numbers; numbers spread repeated rows over all chunks
    placed = scratch.keep(placed.withColumn("number", F.monotonically_increasing_id()))
    chunks = max(1, -(-placed.count() // (shards * CHUNK_ROWS)))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("number"), F.lit(chunks)))
    counts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard", "chunk").orderBy("doc_id", "size", "text_crc32", "number")
    numbered = placed.withColumn("own", F.row_number().over(own) - 1)
    return numbered.join(offsets, ["shard", "chunk"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("own")).alias("slot"), "grown_shard"
    )
