"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

The shard depends on the key and the number of shards alone. With one shard more,
the rows that move all move into the new shard, about one in shards + 1.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, free, stored

#: Rows that one numbering task should get.
ROWS_PER_BUCKET = 250_000


def jump_hashes(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, shard with one shard more) of each uint64 key.

    Every key jumps ahead until the next jump would pass the last shard; a jump that
    lands right behind it is the one that a further shard would take.
    """
    key = keys.astype(np.uint64).copy()
    shard = np.zeros(len(key), np.int64)
    grown = shard.copy()
    live = np.arange(len(key))
    while len(live):
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead = ((shard[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        grown[live] = np.where(ahead <= shards, ahead, shard[live])
        inside = ahead < shards
        live = live[inside]
        shard[live] = ahead[inside]
    return shard.astype(np.int32), grown.astype(np.int32)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each uint64 key."""
    return jump_hashes(keys, shards)[0]


def jump_shards(key: Column, shards: int) -> Column:
    """Column struct<shard, grown> for an integer key; a null key counts as 0."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("shard int, grown int")
    def both(keys: pd.Series) -> pd.DataFrame:
        shard, grown = jump_hashes(keys.to_numpy(np.int64).view(np.uint64), shards)
        return pd.DataFrame({"shard": shard, "grown": grown})

    return both(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def assign_shards(df: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """df with shard, grown_shard (with one shard more) and slot (gapless from 0 in each shard).

    The rows with their shards are stored once, each with a number of its own. They are
    numbered in buckets by a hash of that, so neither a shard, nor a hot key, nor a
    row that is repeated without end meets in one task; each bucket's offset comes from
    the counts of the buckets before it. The counts number shards x rows / 250,000.
    Null keys count as key 0. Repeated rows each get a slot; which of them gets which
    is left open. An empty table gives an empty result. Columns of df named like the
    results are replaced, others may have any name.
    """
    df = df.drop("shard", "grown_shard", "slot")
    both, shard, grown, own, bucket, count, offset, local = free(df, "both", "shard", "grown_shard", "own", "bucket", "count", "offset", "local")
    dealt = stored(df.select(*columns(df), jump_shards(F.col(key), shards).alias(both), F.monotonically_increasing_id().alias(own)), "shards")
    buckets = max(4, -(-dealt.count() // ROWS_PER_BUCKET))
    dealt = dealt.select(*columns(df), F.col(f"{both}.shard").alias(shard), F.col(f"{both}.grown").alias(grown), own, F.pmod(F.xxhash64(own), F.lit(buckets)).cast("int").alias(bucket))
    counts = dealt.groupBy(shard, bucket).agg(F.count(F.lit(1)).alias(count))
    before = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, bucket, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(offset))
    numbered = dealt.withColumn(local, F.row_number().over(Window.partitionBy(shard, bucket).orderBy(own)).cast("long") - 1)
    return numbered.join(offsets, [shard, bucket]).select(*columns(df), shard, (F.col(offset) + F.col(local)).alias("slot"), grown)
