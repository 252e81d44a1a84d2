"""Blocks of a sorted run: packing, index, seek, sizes, checksums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY_OVERHEAD = 6  # two length fields and an offset
BLOCK_OVERHEAD = 2  # the count


def packed_blocks(costs: np.ndarray, block_size: int) -> np.ndarray:
    """Block of each entry in order: an entry opens a block if it doesn't fit behind others; the first always fits."""
    total = np.cumsum(costs)
    out = np.zeros(len(costs), dtype=np.int64)
    start, block = 0, 0
    while start < len(costs):
        held = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, held + block_size - BLOCK_OVERHEAD, side="right")))
        out[start:stop] = block
        start, block = stop, block + 1
    return out


def pack(run: DataFrame, block_size: int, run_id: str = "run_id") -> DataFrame:
    """run_id, key, size of value, block_idx and entry_idx of the entries of sorted runs; sequential in a run, whose size
    compaction bounds."""
    sized = run.select(F.col(run_id).cast("long").alias("run_id"), "key", (F.octet_length("key") + F.octet_length("value") + ENTRY_OVERHEAD).cast("long").alias("cost"))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        rows["block_idx"] = packed_blocks(rows["cost"].to_numpy(), block_size)
        rows["entry_idx"] = rows.groupby("block_idx").cumcount()
        return rows

    kind = run.schema["key"].dataType.simpleString()
    return sized.groupBy("run_id").applyInPandas(fold, f"run_id long, key {kind}, cost long, block_idx long, entry_idx long")


def block_index(packed: DataFrame) -> DataFrame:
    """A row a block: first and last key, entries, encoded bytes."""
    return packed.groupBy("run_id", "block_idx").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("n"), (F.sum("cost") + BLOCK_OVERHEAD).alias("encoded_bytes"))


def find_block(index: DataFrame, key) -> DataFrame:
    """run_id and the block where a key would be: the last whose first key is at most the key, else 0."""
    return index.groupBy("run_id").agg(F.coalesce(F.max(F.when(F.col("first_key") <= F.lit(key), F.col("block_idx"))), F.lit(0).cast("long")).alias("block_idx"))


def seek(run: DataFrame, key) -> DataFrame:
    """The first entry at or above a key of each run; no row past the end."""
    return run.filter(F.col("key") >= F.lit(key)).groupBy("run_id").agg(F.min("key").alias("key"), F.min_by("value", "key").alias("value"))


def encoded_size(key: Column | str = "key", value: Column | str = "value") -> Column:
    """Bytes of a block of the grouped entries: an aggregate."""
    return F.sum(F.octet_length(key) + F.octet_length(value) + ENTRY_OVERHEAD) + BLOCK_OVERHEAD


def with_checksum(run: DataFrame) -> DataFrame:
    """Entries with the CRC-32 of key and value."""
    return run.withColumn("crc", F.crc32(F.concat(F.col("key").cast("binary"), F.col("value").cast("binary"))))


def verified(run: DataFrame) -> DataFrame:
    """The entries; a wrong checksum fails the job."""
    right = F.crc32(F.concat(F.col("key").cast("binary"), F.col("value").cast("binary"))) == F.col("crc")
    return run.filter(F.when(right, True).otherwise(F.raise_error(F.lit("checksum mismatch")).cast("boolean"))).drop("crc")
