"""Exact top-k by inner product with MaxScore, over integer vectors.

A term is a component with a sign; its postings are the rows of a shard whose component has that sign. Against a query, a
term of the query's sign raises a score by at most |q| * (the term's largest weight), and one of the other sign lowers it.
A first threshold, of the whole corpus, is the k-th best score in a sample of at most `SEED_ROWS` candidates, and a shard
raises it by its rows with the largest weights under the query's strongest terms. Terms whose bounds together stay below
it are non-essential: a row in none of the essential postings can't reach the top. The essential postings are traversed
`STEP` rows at a time; for the rows found there, the other terms are probed from the strongest down, and a row is let go
once its score so far and the bounds still to come fall below the threshold. After each step the threshold is the k-th
best score found, and the terms are split anew. A threshold of 0 or less rules nothing out, and all rows are probed.

Candidates are dealt into shards and queries into blocks by a hash of their ids, so that neither equal vectors nor runs of
ids crowd a task; each shard meets each block once, and shard results are merged by score and id. A query block against a
shard is the unit of work: its memory depends on `SHARD_CELLS` and `BLOCK_CELLS`, in vector components, alone. A candidate
moves once for each block of queries and a query once for each shard.

Defined cases: rows with a null id, a null vector, or a null or non-finite component take no part; a row repeated with
equal id and vector counts once; rows with the query's id are its own and no candidates; missing components of shorter
vectors count as 0; ties go to the smaller id; with fewer candidates than k all are returned; empty tables give no rows;
other columns are not read. Scores must fit in 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workdir import prepare

SHARD_CELLS, BLOCK_CELLS = 4 << 20, 1 << 20
LEAST_ROWS = 1024  # of a shard, where more shards only serve to keep all tasks busy
SEED_ROWS = 2048
STEP = 8192
PROBE_STEP = 8  # terms probed between two looks at the threshold
NO_FLOOR = -(1 << 62)

PART = "query_id long, query_key long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and floor(scale * x) of each component, without the rows that take no part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    ids = ids.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(F.coalesce(sound, F.lit(False)))
    return ids.select("vec_id", F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"))


def number_type(rows: np.ndarray, queries: np.ndarray) -> type:
    """Floats where they hold every sum of products exactly, as they multiply faster."""
    most = int(np.abs(rows).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(1, rows.shape[1])
    return np.float64 if most < 1 << 53 else np.int64


def kth_best(score: np.ndarray, k: int) -> int:
    return int(np.partition(score, len(score) - k)[len(score) - k])


class Shard:
    """Candidates of one shard with their postings."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, kind: type = np.int64):
        order = np.argsort(ids, kind="stable")
        self.ids, self.kind = ids[order], kind
        self.by_term = np.ascontiguousarray(rows[order].T.astype(kind))  # component by row
        self.postings = {}
        self.bound = np.zeros((rows.shape[1], 2), dtype=np.int64)
        for d, column in enumerate(self.by_term):
            for side, weight in ((1, column), (0, -column)):
                self.postings[d, side] = np.nonzero(weight > 0)[0].astype(np.int32)
                self.bound[d, side] = max(0, int(weight.max(initial=0)))

    def top(self, query_id: int, q: np.ndarray, k: int, floor: int = NO_FLOOR) -> tuple[np.ndarray, np.ndarray]:
        """Local rows and scores of the k best, in no order; more where scores tie at the end, and none below floor."""
        n = len(self.ids)
        terms = np.nonzero(q)[0]
        side = (q[terms] > 0).astype(int)
        most = np.abs(q[terms]) * self.bound[terms, side]
        order = np.argsort(-most, kind="stable")
        terms, side, most = terms[order], side[order], most[order]
        weight = q[terms].astype(self.kind)
        beyond = np.concatenate([np.cumsum(most[::-1])[::-1], [0]])  # what terms i, i + 1, ... can add at most
        own = self.ids == query_id
        threshold = max(floor, self._seed(q, terms, side, own, k))
        held, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for start in range(0, n, STEP):
            rows = start + np.nonzero(~own[start : start + STEP])[0]
            if threshold > 0 and len(terms):
                rows = rows[self._found(terms, side, int(np.argmax(beyond < threshold)), start, min(n, start + STEP))[rows - start]]
            score = np.zeros(len(rows), dtype=self.kind)
            for i in range(0, len(terms), PROBE_STEP):
                part = terms[i : i + PROBE_STEP]
                score += weight[i : i + PROBE_STEP] @ (self.by_term[part] if len(rows) == n else self.by_term[part[:, None], rows])
                stay = score + beyond[min(i + PROBE_STEP, len(terms))] >= threshold
                if not stay.all():
                    rows, score = rows[stay], score[stay]
            stay = score >= threshold  # a query of zeros probes nothing
            held, scores = np.concatenate([held, rows[stay]]), np.concatenate([scores, score[stay].astype(np.int64)])
            if len(held) >= k:
                threshold = max(threshold, kth_best(scores, k))
                stay = scores >= threshold
                held, scores = held[stay], scores[stay]
        return held, scores

    def _found(self, terms: np.ndarray, side: np.ndarray, essential: int, start: int, stop: int) -> np.ndarray:
        """Which rows of a step are in an essential posting."""
        found = np.zeros(stop - start, dtype=bool)
        for d, s in zip(terms[:essential].tolist(), side[:essential].tolist()):
            posting = self.postings[d, s]
            a, b = np.searchsorted(posting, (start, stop))
            found[posting[a:b] - start] = True
            if found.all():
                break
        return found

    def _seed(self, q: np.ndarray, terms: np.ndarray, side: np.ndarray, own: np.ndarray, k: int) -> int:
        """The k-th best score among some promising rows: no row below it is in the top."""
        picked = [np.zeros(0, dtype=np.int64)]
        for d, s in zip(terms[:8], side[:8]):
            docs = self.postings[d, s]
            weight = np.abs(self.by_term[d, docs])
            picked.append(docs[np.argpartition(-weight, 2 * k)[: 2 * k]] if len(docs) > 2 * k else docs)
        rows = np.unique(np.concatenate(picked))
        rows = rows[~own[rows]]
        return kth_best(q.astype(self.kind) @ self.by_term[:, rows], k) if len(rows) >= k else NO_FLOOR


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), dtype=np.int64)
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    lengths = flat.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), at] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


def with_floors(queries: DataFrame, sample: pa.Table, width: int, k: int) -> DataFrame:
    """queries (vec_id, v) with floor: the k-th best score among the sample's candidates, the query's own rows apart."""
    ids, rows = sample["vec_id"].to_numpy(), _matrix(sample["v"], width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _matrix(pa.chunked_array([batch.column(1)]), width)
            kind = number_type(rows, own)
            score = own.astype(kind) @ rows.astype(kind).T
            floors = []
            for query_id, s in zip(batch.column(0).to_numpy(), score):
                s = s[ids != query_id]
                floors.append(kth_best(s, k) if len(s) >= k else NO_FLOOR)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.int64())], ["vec_id", "v", "floor"])

    return queries.mapInArrow(run, "vec_id long, v array<long>, floor long")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best candidates; both sides as quantised() gives them."""
    spark = candidates.sparkSession
    prepare(spark)
    width, n = candidates.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*")).first()
    asked_width, asked = queries.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*")).first()
    width = max(width, asked_width, 1)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-n * width // SHARD_CELLS), min(tasks, -(-n // LEAST_ROWS)))
    blocks = max(1, -(-asked * width // BLOCK_CELLS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    distinct = candidates.distinct()
    sample = distinct.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id", "v").limit(SEED_ROWS).toArrow()
    left = distinct.select("vec_id", "v", dealt(shards).alias("shard"), every(blocks).alias("block"))
    right = with_floors(queries.distinct(), sample, width, k).select("vec_id", "v", "floor", F.xxhash64("v").alias("key"), dealt(blocks).alias("block"), every(shards).alias("shard"))

    def meet(own: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if len(own) and len(asked):
            rows, ask = _matrix(own["v"], width), _matrix(asked["v"], width)
            shard = Shard(own["vec_id"].to_numpy(), rows, number_type(rows, ask))
            for query_id, key, floor, q in zip(asked["vec_id"].to_numpy(), asked["key"].to_numpy(), asked["floor"].to_pylist(), ask):
                found, score = shard.top(query_id, q, k, floor)
                best = np.lexsort((shard.ids[found], -score))[:k]
                for column, values in zip(out, (np.full(len(best), query_id), np.full(len(best), key), shard.ids[found[best]], score[best])):
                    column.append(values)
        return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out], names=["query_id", "query_key", "vec_id", "score"])

    parts = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(meet, PART)
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
