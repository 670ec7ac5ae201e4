"""Sharding by jump consistent hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daydigest.llm.common import dense_positions, text_or_empty
from daydigest.session import cut_lineage

# Fixed value: the multiplier of the published algorithm's generator.
STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key: follow the jumps of the key's own random
    sequence until one goes beyond the last shard. No table, and with one more shard a key
    stays or jumps to the new one."""
    key = keys.astype(np.uint64, copy=True)
    at = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    going = np.arange(len(key))
    while len(going):
        at[going] = ahead[going]
        key[going] = key[going] * STEP + np.uint64(1)
        draw = (key[going] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[going] = ((at[going] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        going = going[ahead[going] < shards]
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """The shard (0 to ``shards`` - 1) of a hash of ``key``; a null key has a shard too."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("int")
    def assign(hashes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in hashes:
            yield pd.Series(jump(part.to_numpy(np.int64).view(np.uint64), shards))

    return assign(F.xxhash64(key))


def with_shard(df: DataFrame, key: str = "doc_id", shards: int = 16, out: str = "shard") -> DataFrame:
    """``df`` with its shard, which depends on ``key`` and ``shards`` alone; nothing is
    shuffled. Rows of equal key (null too) share a shard. A column named ``out`` is replaced;
    an empty table stays empty."""
    return df.withColumn(out, shard_of(F.col(key), shards))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: int = 16) -> None:
    """Write one folder ``shard=N`` for each shard that has rows. Each task writes its own
    files, so a shard is never gathered in one task."""
    with_shard(df, key, shards).write.partitionBy("shard").parquet(path)


def shard_table(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Where each document goes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``slot`` numbers the rows of a shard from 0 without gaps, in hash order. Null texts have
    size 1 and the checksum 0 of no bytes; repeated rows get a slot each; an empty table
    gives no rows; other columns are ignored. Only ids, sizes and checksums are shuffled.
    """
    text = text_or_empty()
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    # the texts are read once
    placed = cut_lineage(with_shard(rows, "doc_id", shards), "shard-rows")
    slots = dense_positions(placed, "shard", ["doc_id", "size", "text_crc32"], "slot", placed.count())
    return slots.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        "slot",
        shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
