"""Byte-level BPE over a public rank file.

Each pre-token's bytes are the leaves of a segment tree whose nodes hold the leftmost minimum rank of a neighbouring
pair. A merge takes the root's pair, and updates the two leaves of live neighbours and their paths, so a pre-token of n
bytes costs O(n log n). The trees of many pre-tokens stand side by side in one array and take each merge together;
results are kept by pre-token up to a bound, after which the store starts anew.

Defined cases: a null or empty text has no ids; a null id stays null; repeated rows are encoded each; an empty table
gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workdir import prepare

NONE = np.int64(1) << 31  # rank of a pair that never merges; leaves 31 bits for a position
KEEP = 600_000  # pre-tokens a worker keeps

DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

_codecs: dict[tuple[str, str], "Codec"] = {}


class Codec:
    """Ranks of one vocabulary; encode_words and decode are inverse to each other."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.kept: dict[str, bytes] = {}
        # every split of a token into two tokens is a pair that merges into it
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        table = np.array(sorted((a << 32 | b, r) for a, b, r in pairs), dtype=np.int64)
        self.pair_keys, self.pair_ranks = np.ascontiguousarray(table[:, 0]), np.ascontiguousarray(table[:, 1])

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def merge_rows(self, words: list[bytes], width: int) -> list[bytes]:
        """ids of words of at most width bytes (a power of two), as little-endian 32-bit strings."""
        n, bits = len(words), width.bit_length()
        none = NONE << bits
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
        ids = self.byte_id[raw]
        here = np.arange(width)
        alive = here < lengths[:, None]
        follows = np.broadcast_to(here + 1, (n, width)).astype(np.int32).copy()  # next live position
        before = np.broadcast_to(here - 1, (n, width)).astype(np.int32).copy()
        tree = np.full((n, 2 * width), none, dtype=np.int64)  # rank << bits | position: the least is the leftmost minimum
        if width > 1:
            a, b = np.nonzero(alive[:, 1:])
            tree[a, width + b] = self.pair_rank(ids[a, b], ids[a, b + 1]) << bits | b
        for level in _levels(width):
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        rows = np.arange(n)
        while len(rows := rows[tree[rows, 1] < none]):
            best = tree[rows, 1]
            at = best & ((1 << bits) - 1)
            ids[rows, at] = best >> bits
            gone = follows[rows, at]
            alive[rows, gone] = False
            after = follows[rows, gone]
            follows[rows, at] = after
            has_after = after < lengths[rows]
            before[rows[has_after], after[has_after]] = at[has_after]
            tree[rows, width + gone] = none
            tree[rows, width + at] = none
            r, p, q = rows[has_after], at[has_after], after[has_after]
            tree[r, width + p] = self.pair_rank(ids[r, p], ids[r, q]) << bits | p
            prior = before[rows, at]
            has_prior = prior >= 0
            r, p, q = rows[has_prior], prior[has_prior], at[has_prior]
            tree[r, width + p] = self.pair_rank(ids[r, p], ids[r, q]) << bits | p
            for changed, of in ((gone, rows), (at, rows), (p, r)):
                node = (width + changed) >> 1
                while len(node) and node[0]:
                    tree[of, node] = np.minimum(tree[of, 2 * node], tree[of, 2 * node + 1])
                    node = node >> 1
        flat, ends = ids[alive].astype("<u4"), np.cumsum(alive.sum(axis=1)) * 4
        blob = flat.tobytes()
        starts = np.concatenate([[0], ends[:-1]])
        return [blob[s:e] for s, e in zip(starts.tolist(), ends.tolist())]

    def encode_words(self, words: list[str]) -> None:
        """Puts the ids of new pre-tokens among the kept."""
        by_width: dict[int, list[str]] = {}
        for w in words:
            by_width.setdefault(1 << max(0, len(w.encode()) - 1).bit_length(), []).append(w)
        for width, group in by_width.items():
            step = max(1, (1 << 19) // width)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                self.kept.update(zip(part, self.merge_rows([w.encode() for w in part], width)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pattern.findall(t) for t in texts]
        new: set[str] = set()
        for words in split:
            new.update(words)
        if len(self.kept) + len(new - self.kept.keys()) > KEEP:
            self.kept = {}
        self.encode_words(list(new - self.kept.keys()))
        return [b"".join(map(self.kept.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _levels(width: int) -> list[int]:
    """First node of each inner level, the lowest level first."""
    return [width >> k for k in range(1, width.bit_length())]


def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec a worker process."""
    key = (ranks_path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encodes and decodes every whole text; digests of the ids and of the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, ids_sha, text_sha = [], [], []
            for i in range(0, len(texts), 250):
                for ids in own.encode(texts[i : i + 250]):
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [x.split()[0] for x in DIGEST.split(", ")])

    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DIGEST)
