"""Newest-wins resolution and merges of sorted runs.

Predicates on keys may stand above these operators: Catalyst moves them below the aggregate and into the scan. Predicates
on values must stay above, or deleted keys come back with older values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratakv.model import is_tombstone


def newest(log: DataFrame, recency: Column | str = "seq") -> DataFrame:
    """key and value of the newest entry of each key, tombstones too. Combines before the shuffle, so a hot key costs one
    row a task."""
    return log.groupBy("key").agg(F.max_by("value", recency).alias("value"))


def newest_rows(log: DataFrame, recency: tuple[str, ...] = ("batch", "ord")) -> DataFrame:
    """The same with all columns of the newest entry, and a recency of several columns; no window, so it combines too."""
    rest = [c for c in log.columns if c != "key"]
    out = log.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct(*recency)).alias("__newest"))
    return out.select(*[F.col("key") if c == "key" else F.col(f"__newest.{c}") for c in log.columns])


def newest_by_rank(log: DataFrame, recency: Column | str = "seq") -> DataFrame:
    """The same by a window, with all columns of the newest entry."""
    order = Window.partitionBy("key").orderBy((F.col(recency) if isinstance(recency, str) else recency).desc())
    return log.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").drop("__rank")


def live(resolved: DataFrame) -> DataFrame:
    """Without deleted keys; only above newest()."""
    return resolved.filter(~is_tombstone())


def kway_merge(runs: list[DataFrame]) -> DataFrame:
    """One entry a key of several runs; the later run of the list wins. Tombstones stay."""
    if not runs:
        raise ValueError("no runs to merge")
    tagged = [r.select("key", "value", F.lit(i).alias("prio")) for i, r in enumerate(runs)]
    return newest(reduce(DataFrame.unionByName, tagged), "prio")


def two_way_merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """One entry a key of two runs; the first wins."""
    return first.select("key", "value").unionByName(second.select("key", "value").join(first.select("key"), "key", "left_anti"))


def concat(runs: list[DataFrame]) -> DataFrame:
    """Runs known to be apart: no shuffle."""
    return reduce(DataFrame.unionByName, [r.select("key", "value") for r in runs])


def disjoint_check(catalog: DataFrame) -> DataFrame:
    """run_id, and whether the run is in order in itself and lies behind the run before it. catalog: run_id, pos,
    first_key, last_key; it has a row a run, so one task holds it."""
    before = F.lag("last_key").over(Window.orderBy("pos"))
    return catalog.select("run_id", ((F.col("first_key") <= F.col("last_key")) & F.coalesce(before < F.col("first_key"), F.lit(True))).alias("ok"))


def apart(catalog: DataFrame) -> bool:
    return disjoint_check(catalog).filter("not ok").limit(1).count() == 0
