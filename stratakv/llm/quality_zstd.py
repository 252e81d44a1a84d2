"""Quality classifier by compression.

Two zstandard dictionaries are built from good and from bad labelled text. Every whole text is cut into blocks of
`BLOCK` bytes, so that a dictionary counts as much at a long text's end as at its start, and all blocks are compressed
with either. The difference of the two sums over the text's own size, (bad - good) / (size + SMOOTH), is the one feature;
logistic regression on labelled rows that neither dictionary has seen turns it into a probability.

Bounds: at most `max_rows` labelled rows of each class reach the driver, of those with at most `max_chars` characters the
first by a hash of the id. Scoring reads every row. Labels, languages, sources and ids are never inputs.

Defined cases: a null text counts as empty, and an empty text's feature is 0; null labels, other labels than 0 and 1 and
null ids teach nothing; with no labelled row every score is 0.5, with one class the score leans to that class by Laplace's
rule; repeated rows are scored each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workdir import prepare

BLOCK = 256
SMOOTH = 64
LEVEL = 3
DICT_BYTES = 112_640
CUT = 0.3

SCORED = "doc_id long, held_out boolean, score double, predicted int"

_loaded: dict[bytes, tuple] = {}


@dataclass
class QualityModel:
    """Dictionaries (None where no text taught them) and the calibration's slope and intercept."""

    good: bytes | None
    bad: bytes | None
    slope: float
    intercept: float


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    own = zstandard.ZstdCompressionDict(content)
    own.precompute_compress(level=LEVEL)
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=own, compression_params=params)


def features(texts: list[str | None], good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> np.ndarray:
    out = np.zeros(len(texts))
    for k, text in enumerate(texts):
        raw = memoryview((text or "").encode("utf-8", "surrogatepass"))
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        g, b = (sum(len(c.compress(x)) for x in blocks) for c in (good, bad))
        out[k] = (b - g) / (len(raw) + SMOOTH)
    return out


def _dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; where there is too little text to train on, the text itself is the dictionary."""
    samples = [x for t in texts for raw in [t.encode("utf-8", "surrogatepass")] for i in range(0, len(raw), BLOCK) if len(x := raw[i : i + BLOCK]) >= 8]
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, total // 8)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(samples)[-DICT_BYTES:].rjust(8, b" ")


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one feature by Newton's method, with a slight ridge on the slope."""
    scale = x.std() or 1.0
    rows, beta = np.stack([x / scale, np.ones_like(x)], axis=1), np.zeros(2)
    ridge = np.array([1e-2, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        grad = rows.T @ (weight * (y - p)) - ridge * beta
        step = np.linalg.solve((rows * (weight * p * (1 - p))[:, None]).T @ rows + np.diag(ridge + 1e-9), grad)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, teaches, max_rows: int = 2000, max_chars: int = 20_000) -> QualityModel:
    """Learns from rows of `labels` for which the column teaches(doc_id) is true, joined with their texts."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    own = own.filter(teaches(F.col("doc_id")) & F.col("quality").isin(0, 1))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.length("text").between(1, max_chars))
    able = own.distinct().join(texts.select("doc_id").distinct(), "doc_id")  # ids with a text that may teach
    picked, other = (able.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for q in (0, 1))
    picked = picked.unionByName(other)
    prior = {r["quality"]: r["count"] for r in own.groupBy("quality").count().collect()}
    # at most 2 * max_rows ids are broadcast; of an id's texts the least teaches
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["quality"], hash_order(r["doc_id"]), r["text"]))
    by = {q: [r["text"] for r in rows if r["quality"] == q] for q in (0, 1)}
    if not by[0] or not by[1]:
        n0, n1 = len(by[0]), len(by[1])
        return QualityModel(None, None, 0.0, float(np.log((n1 + 1) / (n0 + 1))))
    teach, judge = ({q: t[k::2] or t for q, t in by.items()} for k in (0, 1))
    good, bad = _dictionary(teach[1]), _dictionary(teach[0])
    x = features(judge[1] + judge[0], _compressor(good), _compressor(bad))
    y = np.concatenate([np.ones(len(judge[1])), np.zeros(len(judge[0]))])
    weight = np.where(y == 1, prior[1] / len(judge[1]), prior[0] / len(judge[0]))
    slope, intercept = _logistic(x, y, weight * len(y) / weight.sum())
    return QualityModel(good, bad, slope, intercept)


def hash_order(doc_id: int) -> int:
    """An order of ids that has nothing to do with how they were given out."""
    return (doc_id * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64) >> 11


def scorer(model: QualityModel):
    """A function of texts that a worker sets up once a model."""
    blob = pickle.dumps(model)
    key = hashlib.sha256(blob).digest()

    def score_of(texts: list[str | None]) -> np.ndarray:
        if key not in _loaded:
            own = pickle.loads(blob)
            _loaded.clear()
            _loaded[key] = (own, *([_compressor(own.good), _compressor(own.bad)] if own.good else [None, None]))
        own, good, bad = _loaded[key]
        x = features(texts, good, bad) if good else np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(own.slope * x + own.intercept, -30, 30)))

    return score_of


def score(docs: DataFrame, model: QualityModel, held_out, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, and predicted: 1 if score >= cut, else 0."""
    score_of = scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = score_of(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= cut).astype(np.int32))], [c.split()[0] for c in SCORED.split(", ")])

    prepare(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ids.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text").mapInArrow(run, SCORED)


def accepted(docs: DataFrame, model: QualityModel, cut: float = CUT) -> DataFrame:
    """The rows, with all their columns, whose text scores at least cut."""
    at, score_of = docs.columns.index("text"), scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score_of(batch.column(at).to_pylist()) >= cut))

    prepare(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def fold(doc_id, of: int):
    """crc32 of an id as text, modulo `of`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of
