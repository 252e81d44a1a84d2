"""Data model: entries, bounds, options, and key-value views over the sample tables.

An entry is (key, value) with a recency; the empty value is a tombstone. Keys and values are binary in stores; every
operator also takes strings, whose order and lengths are those of their UTF-8 bytes.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "batch long, ord long, key binary, value binary"


@dataclass(frozen=True)
class Bound:
    """One end of a key range."""

    kind: str
    value: Any = None

    @staticmethod
    def included(value) -> Bound:
        return Bound("included", value)

    @staticmethod
    def excluded(value) -> Bound:
        return Bound("excluded", value)

    @staticmethod
    def unbounded() -> Bound:
        return Bound("unbounded")


UNBOUNDED = Bound("unbounded")


def key_range(lower: Bound, upper: Bound, key: Column | str = "key") -> Column | None:
    """The predicate of a range, one of nine shapes; None if both ends are open. Raises if the ends are the wrong way."""
    if lower.kind != "unbounded" and upper.kind != "unbounded" and lower.value > upper.value:
        raise ValueError("the lower bound is above the upper bound")
    key = F.col(key) if isinstance(key, str) else key
    parts = []
    if lower.kind != "unbounded":
        parts.append(key >= F.lit(lower.value) if lower.kind == "included" else key > F.lit(lower.value))
    if upper.kind != "unbounded":
        parts.append(key <= F.lit(upper.value) if upper.kind == "included" else key < F.lit(upper.value))
    return None if not parts else parts[0] if len(parts) == 1 else parts[0] & parts[1]


@dataclass(frozen=True)
class NoCompact:
    """Runs stay where flushes put them."""


@dataclass(frozen=True)
class Simple:
    """Compaction by ratios of file counts between levels."""

    size_ratio_percent: int = 200
    max_level0_files: int = 2
    max_levels: int = 3


@dataclass(frozen=True)
class Options:
    block_size: int = 4096
    memtable_limit: int = 2
    run_size: int = 1 << 20
    keep_versions: int = 4
    strategy: NoCompact | Simple = Simple()

    def __post_init__(self):
        if not isinstance(self.strategy, (NoCompact, Simple)):
            raise ValueError("only NoCompact and Simple strategies can be run")


def require_keys(df: DataFrame) -> DataFrame:
    """Fails the job on a null or empty key, or a null value."""
    bad = F.col("key").isNull() | (F.octet_length("key") == 0) | F.col("value").isNull()
    return df.filter(F.when(bad, F.raise_error(F.lit("a key is empty or null, or a value is null")).cast("boolean")).otherwise(True))


def is_tombstone(value: Column | str = "value") -> Column:
    return F.octet_length(value) == 0


def signed_order(key: Column | str = "key") -> Column:
    """A string that sorts as the key does by signed bytes: each byte's first hex digit, rotated by eight."""
    digits = F.hex(key)
    turned = F.transform(
        F.sequence(F.lit(1), F.length(digits), F.lit(2)),
        lambda i: F.concat(F.translate(F.substring(digits, i, F.lit(1)), "0123456789ABCDEF", "89ABCDEF01234567"), F.substring(digits, i + 1, F.lit(1))),
    )
    return F.when(F.octet_length(key) > 0, F.array_join(turned, "")).otherwise("")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, key, value of the events table: errors are deletes."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.when(F.col("event_type") == "error", "").otherwise(F.concat("event_type", F.lit(":"), "props"))
    return events.select(F.col("event_id").alias("seq"), F.format_string("user_%05d_%02d", "user_id", F.col("event_id") % 7).alias("key"), value.alias("value"))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("seq"), F.format_string("order_%08d", "o_orderkey").alias("key"), F.concat("o_orderstatus", F.lit(":"), "o_orderpriority").alias("value"))
