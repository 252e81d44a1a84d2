"""Memory lifecycle: which segment of the log each entry falls in, and what is due for flushing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FROZEN = "seq long, size long, segment_id long"
CHUNK_SEGMENTS = 32  # segments that a chunk of the log should hold, so that what chunks say of themselves is little
ALWAYS = (1 << 63) - 1  # room in which the whole of any chunk fits
CHUNK_BITS = (16, 22)  # entries of a chunk, at least and at most, as powers of two


def entry_size(log: DataFrame) -> DataFrame:
    """Bytes of keys and values as they count towards freezing: overwrites count again."""
    return log.withColumn("size", (F.octet_length("key") + F.octet_length("value")).cast("long"))


def frozen_ids(sizes: np.ndarray, threshold: int, held: int = 0) -> np.ndarray:
    """Segment of each entry in order: the entry that reaches the threshold ends its segment. The first segment holds
    `held` bytes already."""
    total = np.cumsum(sizes)
    out = np.zeros(len(sizes), dtype=np.int64)
    start, segment, base = 0, 0, -held
    while start < len(sizes):
        stop = int(np.searchsorted(total, base + threshold, side="left")) + 1
        out[start:stop] = segment
        base = total[min(stop, len(sizes)) - 1]
        start, segment = stop, segment + 1
    return out


def transitions(sizes: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a chunk of the log does to a segment that comes into it with room for `room` bytes. The first row with
    upto >= room holds the number of segments that end in the chunk and the bytes that the last one is left with; if there
    is none, no segment ends. Rows of equal outcome are one: segments that start apart soon end together."""
    total = np.cumsum(sizes)
    first = total[: int(np.searchsorted(total, threshold, side="left")) + 1]
    base, ends = first.copy(), np.ones(len(first), dtype=np.int64)
    going = np.arange(len(first))
    while len(going):
        stop = np.searchsorted(total, base[going] + threshold, side="left")
        going, stop = going[stop < len(total)], stop[stop < len(total)]
        base[going] = total[stop]
        ends[going] += 1
    left = total[-1:] - base
    last = np.append((ends[1:] != ends[:-1]) | (left[1:] != left[:-1]), np.ones(min(1, len(first)), dtype=bool))
    return first[last], ends[last], left[last]


def _chunk_bits(sized: DataFrame, threshold: int) -> int:
    n, size, low, high = sized.agg(F.count("*"), F.sum("size"), F.min("seq"), F.max("seq")).first()
    if not n or not size:
        return CHUNK_BITS[0]
    wanted = CHUNK_SEGMENTS * threshold * (high - low + 1) // size
    return min(max(int(wanted).bit_length(), CHUNK_BITS[0]), CHUNK_BITS[1])


def freeze(log: DataFrame, threshold: int, bits: int | None = None) -> DataFrame:
    """seq, size, segment_id of one writer's log; seq is unique.

    The fold is sequential by definition, so it is done twice over chunks of 2 ** bits sequence numbers, all at once: first
    each chunk says what it does to any segment that comes into it, a walk over these short tables gives each chunk its
    first segment and the bytes in it, and then the chunks are cut. A chunk takes sixteen bytes an entry."""
    sized = entry_size(log).select(F.col("seq").cast("long").alias("seq"), "size")
    bits = _chunk_bits(sized, threshold) if bits is None else bits
    chunked = sized.withColumn("chunk", F.shiftright("seq", bits))

    def told(rows: pa.Table) -> pa.Table:
        sizes = rows.sort_by("seq")["size"].to_numpy()
        upto, ends, left = (np.append(x, y) for x, y in zip(transitions(sizes, threshold), (ALWAYS, 0, sizes.sum())))
        return pa.table({"chunk": np.repeat(rows["chunk"][0].as_py(), len(upto)), "upto": upto, "ends": ends, "left": left})

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, segment, done = 0, 0, None
        for batch in batches:
            chunk, upto, ends, left = (batch.column(c).to_numpy() for c in range(4))
            out = []
            stops = [*(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for start, stop in zip([0, *stops], stops):
                at = start + int(np.searchsorted(upto[start:stop], threshold - held, side="left"))
                if start == stop or chunk[start] == done or at == stop:
                    continue
                out.append((int(chunk[at]), held, segment))
                done = chunk[at]
                held = int(left[at]) + (held if upto[at] == ALWAYS else 0)
                segment += int(ends[at])
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], ["chunk", "held", "segment"])

    def cut(rows: pa.Table, first: pa.Table) -> pa.Table:
        rows = rows.sort_by("seq")
        ids = frozen_ids(rows["size"].to_numpy(), threshold, first["held"][0].as_py()) + first["segment"][0].as_py()
        return pa.table([rows["seq"], rows["size"], pa.array(ids)], names=["seq", "size", "segment_id"])

    tables = chunked.groupBy("chunk").applyInArrow(told, "chunk long, upto long, ends long, left long")
    firsts = tables.repartition(1).sortWithinPartitions("chunk", "upto").mapInArrow(walked, "chunk long, held long, segment long")
    return chunked.groupBy("chunk").cogroup(firsts.groupBy("chunk")).applyInArrow(cut, FROZEN)


def segments(frozen: DataFrame) -> DataFrame:
    """segment_id, n, bytes, first_seq, last_seq."""
    return frozen.groupBy("segment_id").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def flushable(segments_of: DataFrame, memtable_limit: int) -> DataFrame:
    """Segments with their state: the last is mutable; of the others all but the newest limit - 1 are due."""
    age = F.row_number().over(Window.orderBy(F.desc("segment_id"))) - 1  # one row a segment
    state = F.when(F.col("age") == 0, "mutable").when(F.col("age") <= memtable_limit - 1, "immutable").otherwise("flushable")
    return segments_of.withColumn("age", age).withColumn("state", state).drop("age")
