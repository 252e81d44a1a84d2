"""Reads: point get, multi-get, bounded scan, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakv.model import UNBOUNDED, Bound, key_range, signed_order
from stratakv.operators.resolve import live, newest

BROADCAST_KEYS = 100_000


def get(log: DataFrame, key, recency: Column | str = "seq") -> DataFrame:
    """The live entry of a key: one row or none."""
    return live(newest(log.filter(F.col("key") == F.lit(key)), recency))


def multi_get(log: DataFrame, keys: DataFrame, recency: Column | str = "seq", few: bool | None = None) -> DataFrame:
    """Live entries of the keys of a DataFrame. Up to BROADCAST_KEYS keys go to the log, more meet it by a shuffle; few
    says which where the caller knows the number."""
    wanted = keys.select("key").distinct()
    if few is None:
        few = wanted.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return live(newest(log.join(F.broadcast(wanted) if few else wanted, "key", "left_semi"), recency))


def scan(log: DataFrame, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED, recency: Column | str = "seq", limit: int | None = None, signed: bool = False, ordered: bool = True) -> DataFrame:
    """Live entries of a key range, in key order; by signed bytes if asked."""
    wanted = key_range(lower, upper)
    out = live(newest(log if wanted is None else log.filter(wanted), recency))
    if ordered:
        out = out.orderBy(signed_order() if signed else F.col("key"))
    return out if limit is None else out.limit(limit)


def history(log: DataFrame, key, recency: str = "seq") -> DataFrame:
    """All versions of a key, newest first."""
    return log.filter(F.col("key") == F.lit(key)).orderBy(F.desc(recency))


def put(log: DataFrame, entries: DataFrame) -> DataFrame:
    """The log with newer entries."""
    return log.unionByName(entries)


def delete(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The log with tombstones for the keys, present or not. keys: seq, key."""
    return log.unionByName(keys.withColumn("value", F.lit("").cast(log.schema["value"].dataType)))
