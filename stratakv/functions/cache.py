"""A block cache's hits over a trace of reads."""

from __future__ import annotations

from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class LRUCache:
    """Keeps the most recently used values up to a number of bytes. Putting a key that is there renews its recency and
    keeps its value; a value larger than the cache is not kept."""

    def __init__(self, capacity: int):
        self.capacity, self.size, self.held = capacity, 0, OrderedDict()

    def get(self, key):
        if key not in self.held:
            return None
        self.held.move_to_end(key)
        return self.held[key][0]

    def put(self, key, value, size: int) -> None:
        if key in self.held:
            self.held.move_to_end(key)
            return
        if size > self.capacity:
            return
        while self.size + size > self.capacity:
            self.size -= self.held.popitem(last=False)[1][1]
        self.held[key] = (value, size)
        self.size += size


def reuse(trace: DataFrame) -> DataFrame:
    """Reads with the time since the block was last read, by file: seq, run_id, block, gap (null the first time)."""
    order = Window.partitionBy("run_id", "block").orderBy("seq")
    return trace.withColumn("gap", F.col("seq") - F.lag("seq").over(order))


def cache_hits(trace: DataFrame, capacity: int) -> DataFrame:
    """seq, run_id, block, hit: each file's reads, in order, through an LRU cache of `capacity` blocks. Sequential in a file,
    whose reads are one task's, 16 bytes each."""

    def replayed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seq")
        cache, hit = LRUCache(capacity), []
        for block in rows["block"].to_pylist():
            hit.append(cache.get(block) is not None)
            if not hit[-1]:
                cache.put(block, block, 1)
        return rows.append_column("hit", pa.array(hit, pa.bool_()))

    kind = {f.name: f.dataType.simpleString() for f in trace.schema.fields}
    out = trace.select("seq", "run_id", "block")
    return out.groupBy("run_id").applyInArrow(replayed, f"seq {kind['seq']}, run_id {kind['run_id']}, block {kind['block']}, hit boolean")
