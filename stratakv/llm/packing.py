"""Best-fit packing of token sequences into bins of a fixed capacity.

Only lengths matter to packing, and there are at most `capacity` of them. So the corpus is tokenised once, a histogram
of lengths (at most `capacity` rows) goes to the driver, the plan is made there on run lengths, and every piece finds
its place by its length and its rank among the pieces of that length. No bin, document or id list reaches the driver.

Method: pieces above a third of the capacity are matched greedily, at most two in a bin, the longest first with the
longest that still fits; shorter pieces follow in falling order, each into the bin with the least room that holds it.

Defined cases: a null or empty text is the end id alone; a null id stays null; repeated rows are packed each on its
own; an empty table gives no rows; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workdir import Table, prepare

CAPACITY = 2048
END_ID = 0
SPECIAL = "<|endoftext|>"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

_loaded: dict[str, object] = {}


def _encoder(ranks_path: str, json_path: str, pattern: str):
    """ids of a text. The rank file holds the vocabulary of the JSON file and is several times faster; texts that spell
    the special token, which the two libraries treat differently, go to the JSON file's own library."""
    if ranks_path not in _loaded:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _loaded[ranks_path] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    fast = _loaded[ranks_path]

    def encode(text: str) -> list[int]:
        if SPECIAL in text:
            if json_path not in _loaded:
                from tokenizers import Tokenizer

                _loaded[json_path] = Tokenizer.from_file(json_path)
            return _loaded[json_path].encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be short."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * (first > 0) + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, ranks_path: str, json_path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece, with the task that made it and its place among that task's pieces of the same length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = _encoder(ranks_path, json_path, pattern), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.asarray([*encode(text.as_py() or ""), END_ID], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    row = (doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, seen[length])
                    seen[length] += 1
                    for column, value in zip(out, row):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[str, np.ndarray], int]:
    """Runs of equal bins for a histogram of lengths, as slots (length, first rank, first bin, copies in a bin, offset),
    and the number of bins."""
    left = {s: n for s, n in counts.items() if n > 0}
    large = sorted(s for s in left if 3 * s > capacity)
    groups: dict[int, list[list]] = {}  # by room: [bins, items]; an item is (length, copies)
    rooms: list[int] = []

    def open_group(room: int, bins: int, items: list) -> None:
        if bins:
            if room not in groups:
                bisect.insort(rooms, room)
            groups.setdefault(room, []).append([bins, items])

    for s in reversed(large):
        while left[s]:
            k = bisect.bisect_right(large, min(s, capacity - s)) - 1
            while k >= 0 and (not left[large[k]] or large[k] == s and left[s] < 2):
                k -= 1
            if k < 0:
                open_group(capacity - s, left[s], [(s, 1)])
                left[s] = 0
            elif (t := large[k]) == s:
                open_group(capacity - 2 * s, left[s] // 2, [(s, 2)])
                left[s] %= 2
            else:
                n = min(left[s], left[t])
                open_group(capacity - s - t, n, [(s, 1), (t, 1)])
                left[s] -= n
                left[t] -= n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            k = bisect.bisect_left(rooms, s)
            if k < len(rooms):
                room = rooms[k]
                bins, items = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[k]
            else:
                room, bins, items = capacity, -(-n // (capacity // s)), []
            fit = room // s
            whole = min(bins, n // fit)
            open_group(room - fit * s, whole, [*items, (s, fit)])
            n -= whole * fit
            rest = bins - whole
            if rest and n:  # fewer than fit are left: they share one bin
                open_group(room - n * s, 1, [*items, (s, n)])
                rest, n = rest - 1, 0
            if rest and items:
                open_group(room, rest, items)
    rows, first, given = [], 0, Counter()
    for room in sorted(groups):
        for bins, items in groups[room]:
            offset = 0
            for s, copies in items:
                rows.append((s, given[s], first, copies, offset))
                given[s] += bins * copies
                offset += s * copies
            first += bins
    rows.sort()
    names = ("length", "rank", "bin", "copies", "offset")
    return {k: np.array([r[i] for r in rows], dtype=np.int64) for i, k in enumerate(names)}, first


def pack(docs: DataFrame, ranks_path: str, json_path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence_id and its offset there; see the module's text for the method and defined cases."""
    pieces = Table(token_pieces(docs, ranks_path, json_path, pattern, capacity), "pieces").df
    by_task = pieces.groupBy("part", "length").count()
    slots, _ = plan_bins({r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = pieces.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank"))
    keys = (slots["length"] << 48) + slots["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            over = rank - slots["rank"][at]
            copies = slots["copies"][at]
            where = [slots["bin"][at] + over // copies, slots["offset"][at] + over % copies * length]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *map(pa.array, where)], [x.split()[0] for x in PACKED.split(", ")])

    return ranked.mapInArrow(place, PACKED)
