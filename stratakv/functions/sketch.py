"""64- and 32-bit Murmur2 hashes, and Bloom filters over them."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published constants of MurmurHash64A and MurmurHash2, and the seeds in use.
M64, R64, SEED64 = 0xC6A4A7935BD1E995, 47, 0xE17A1465
M32, R32, SEED32 = 0x5BD1E995, 24, 0x9747B28C
FALSE_POSITIVES = 0.03


def _by_length(values: list[bytes], hashed: Callable[[np.ndarray, int], np.ndarray], kind) -> np.ndarray:
    """Hashes values of equal length together: a two-dimensional array of bytes each time."""
    out = np.zeros(len(values), dtype=kind)
    lengths = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        rows = np.frombuffer(b"".join(values[i] for i in at), dtype=np.uint8).reshape(len(at), n)
        out[at] = hashed(rows, int(n))
    return out


def murmur64(values: list[bytes], seed: int = SEED64) -> np.ndarray:
    """MurmurHash64A as signed 64-bit integers."""
    m, r = np.uint64(M64), np.uint64(R64)

    def hashed(rows: np.ndarray, n: int) -> np.ndarray:
        h = np.full(len(rows), np.uint64(seed) ^ np.uint64(n * M64 & (1 << 64) - 1), dtype=np.uint64)
        whole = n // 8
        words = np.ascontiguousarray(rows[:, : 8 * whole]).view("<u8").reshape(len(rows), whole).astype(np.uint64)
        for i in range(whole):
            k = words[:, i] * m
            k ^= k >> r
            h = (h ^ k * m) * m
        if n % 8:
            tail = np.zeros(len(rows), dtype=np.uint64)
            for i in range(8 * whole, n):
                tail |= rows[:, i].astype(np.uint64) << np.uint64(8 * (i - 8 * whole))
            h = (h ^ tail) * m
        h ^= h >> r
        h *= m
        return h ^ (h >> r)

    return _by_length(values, hashed, np.uint64).view(np.int64)


def murmur32(values: list[bytes], seed: int = SEED32) -> np.ndarray:
    """MurmurHash2 as signed 32-bit integers."""
    m, r = np.uint32(M32), np.uint32(R32)

    def hashed(rows: np.ndarray, n: int) -> np.ndarray:
        h = np.full(len(rows), (seed ^ n) & 0xFFFFFFFF, dtype=np.uint32)
        whole = n // 4
        words = np.ascontiguousarray(rows[:, : 4 * whole]).view("<u4").reshape(len(rows), whole).astype(np.uint32)
        for i in range(whole):
            k = words[:, i] * m
            k ^= k >> r
            h = h * m ^ k * m
        if n % 4:
            tail = np.zeros(len(rows), dtype=np.uint32)
            for i in range(4 * whole, n):
                tail |= rows[:, i].astype(np.uint32) << np.uint32(8 * (i - 4 * whole))
            h = (h ^ tail) * m
        h ^= h >> np.uint32(13)
        h *= m
        return h ^ (h >> np.uint32(15))

    return _by_length(values, hashed, np.uint32).view(np.int32)


def _column(hashed, kind: str) -> Callable[[Column | str], Column]:
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(hashed([bytes(v) for v in values]))

    def of(value: Column | str) -> Column:
        udf = F.pandas_udf(run, kind)
        value = F.col(value) if isinstance(value, str) else value
        return F.when(value.isNotNull(), udf(F.coalesce(value.cast("binary"), F.lit(b""))))

    return of


hash64 = _column(murmur64, "long")
hash32 = _column(murmur32, "int")


def total_bits(n: int, p: float = FALSE_POSITIVES) -> int:
    return int(-n * math.log(p) / math.log(2) ** 2)


def hash_count(n: int, p: float = FALSE_POSITIVES) -> int:
    return max(1, math.floor(total_bits(n, p) // n * math.log(2) + 0.5)) if n else 1


def total_bits_column(n: Column, p: float = FALSE_POSITIVES) -> Column:
    return F.floor(-n * math.log(p) / math.log(2) ** 2).cast("long")


def hash_count_column(n: Column, p: float = FALSE_POSITIVES) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.round(F.floor(total_bits_column(n, p) / n) * math.log(2)).cast("long"))


def positions(h: Column, m: Column, k: Column) -> Column:
    """Bits of a 64-bit hash in a filter of m bits by k functions: low + i * high in 32 bits, negatives complemented."""
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
    wrapped = lambda i: (low + i * high).bitwiseAND(F.lit(0xFFFFFFFF))
    folded = lambda x: F.when(x >= 1 << 31, F.lit(0xFFFFFFFF) - x).otherwise(x)
    return F.transform(F.sequence(F.lit(1).cast("long"), k), lambda i: folded(wrapped(i)) % m)


def build(keys: DataFrame, by: str = "run_id", p: float = FALSE_POSITIVES) -> DataFrame:
    """by, n, m, k and the sorted set bits of a filter over each group's keys."""
    sized = keys.groupBy(by).agg(F.count("*").alias("n"))
    sized = sized.withColumns({"m": total_bits_column(F.col("n"), p), "k": hash_count_column(F.col("n"), p)})
    bits = keys.select(by, hash64("key").alias("h")).join(sized, by).select(by, F.explode(positions(F.col("h"), F.col("m"), F.col("k"))).alias("bit"))
    return sized.join(bits.groupBy(by).agg(F.sort_array(F.collect_set("bit")).alias("bits")), by)


def probe(filters: DataFrame, asked: DataFrame, by: str = "run_id") -> DataFrame:
    """by, key, maybe of each asked (by, key): whether that group's filter may hold the key. A key's bits meet the
    filters' bits by a join, so a filter of any size is spread over the cluster."""
    bits = filters.select(by, F.explode("bits").alias("bit"), F.lit(1).alias("set"))
    wanted = asked.select(by, "key", hash64("key").alias("h")).distinct().join(filters.select(by, "m", "k"), by)
    wanted = wanted.select(by, "key", F.explode(F.array_distinct(positions(F.col("h"), F.col("m"), F.col("k")))).alias("bit"))
    return wanted.join(bits, [by, "bit"], "left").groupBy(by, "key").agg((F.count("set") == F.count("*")).alias("maybe"))


class BloomFilter:
    """A filter in the driver, for one run's metadata."""

    def __init__(self, n: int, p: float = FALSE_POSITIVES):
        self.n, self.p, self.m, self.k = n, p, total_bits(n, p), hash_count(n, p)
        self.bits = bytearray(-(-self.m // 8))

    def _positions(self, key: bytes) -> list[int]:
        h = int(murmur64([key])[0])
        low, high, out = h & 0xFFFFFFFF, h >> 32 & 0xFFFFFFFF, []
        for i in range(1, self.k + 1):
            x = (low + i * high) & 0xFFFFFFFF
            out.append((x if x < 1 << 31 else 0xFFFFFFFF - x) % self.m)
        return out

    def add(self, key: bytes) -> None:
        for b in self._positions(key):
            self.bits[b >> 3] |= 1 << (b & 7)

    def contains(self, key: bytes) -> bool:
        return all(self.bits[b >> 3] >> (b & 7) & 1 for b in self._positions(key))

    def encode(self) -> bytes:
        body = bytes(self.bits) + struct.pack(">dI", self.p, self.n)
        return body + struct.pack(">I", zlib.crc32(body))

    @staticmethod
    def decode(data: bytes) -> BloomFilter:
        body, crc = data[:-4], struct.unpack(">I", data[-4:])[0]
        if zlib.crc32(body) != crc:
            raise ValueError("checksum mismatch")
        p, n = struct.unpack(">dI", body[-12:])
        out = BloomFilter(n, p)
        out.bits = bytearray(body[:-12])
        return out


PIECE_BITS = 1 << 15
PIECE_ROWS = "part int, piece int, bits binary"


def _positions_of(hashes: np.ndarray, m: int, k: int) -> np.ndarray:
    """Bits of 64-bit hashes, a row for each function."""
    h = hashes.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
    x = (low + np.arange(1, k + 1, dtype=np.uint64)[:, None] * high) & np.uint64(0xFFFFFFFF)
    return np.where(x < np.uint64(1 << 31), x, np.uint64(0xFFFFFFFF) - x) % np.uint64(m)


def filter_pieces(keys: DataFrame) -> DataFrame:
    """part, piece, bits: a filter over each part's keys (as many as the part has rows), in pieces of PIECE_BITS. A part is
    one slice of a run, whose entries its writer bounds; its filter takes about a byte a key."""

    def fold(rows: pa.Table) -> pa.Table:
        n = len(rows)
        m, k = total_bits(n), hash_count(n)
        held = np.zeros(-(-m // PIECE_BITS) * PIECE_BITS, dtype=np.uint8)
        for i in range(0, n, 1 << 16):
            held[_positions_of(murmur64(rows["key"].slice(i, 1 << 16).to_pylist()), m, k).astype(np.int64)] = 1
        pieces = np.packbits(held.reshape(-1, PIECE_BITS), axis=1, bitorder="little")
        part = rows["part"][0].as_py()
        return pa.table([pa.array([part] * len(pieces), pa.int32()), pa.array(range(len(pieces)), pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], names=["part", "piece", "bits"])

    return keys.groupBy("part").applyInArrow(fold, PIECE_ROWS)


def pieces_of(key: bytes, n: int) -> list[tuple[int, int]]:
    """Piece and bit in it of each of a key's bits in a filter over n keys."""
    at = _positions_of(murmur64([key]), total_bits(n), hash_count(n))[:, 0].tolist()
    return [(int(b) // PIECE_BITS, int(b) % PIECE_BITS) for b in at]
