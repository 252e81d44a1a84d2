"""Language identification as inference of a mixture.

Each language is a distribution over hashed byte trigrams (letters lower-cased, everything else that is ASCII counts as
one separator). A text's trigrams come from a mixture of the languages; expectation-maximisation finds the proportions.
Which languages are in the mixture at all is settled by penalised likelihood: for k = 1, 2, ... the k languages of the
largest proportions are fitted anew, and each language beyond the first must raise the log-likelihood by more than
`PENALTY` * ln(number of trigrams). A set is left out unfitted only where it can't win: no mixture beats the full fit by
more than the full fit's duality gap. The prediction is the largest proportion of the chosen set; the set and its
proportions are further columns, the largest first.

Bounds: at most `max_rows` labelled texts a language and `max_total` in all, of at most `max_chars` characters, reach the
driver: those whose hash of the id falls below a share of all that a count of the language's rows gives. Every row's
whole text is predicted. Language, source and id are never inputs.

Defined cases: a null text and a text without a letter (of a letter category of Unicode) are `und` with score 0 and no
languages, and so is every text if nothing was learned; null languages and ids teach nothing; ties go to the language
that sorts first; repeated rows are predicted each, and teach once; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_zstd import hash_order
from .textbytes import flat, runs
from .workdir import prepare

BUCKETS = 8192
PENALTY = 4.0
ROUNDS = 8
CHUNK = 1 << 20

SAMPLE_STEPS = 1 << 30  # of the hash that samples
BROADCAST_LANGS = 50_000

PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>, proportions array<double>"

LETTER = regex.compile(r"\p{L}")
_CODE = np.arange(256, dtype=np.uint32)
_CODE[:128] = 0
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)


def trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that starts at each byte but the last two."""
    code = _CODE[data]
    key = code[:-2] * np.uint32(65536) + code[1:-1] * np.uint32(256) + code[2:]
    return (key * np.uint32(2654435761)) >> np.uint32(32 - 13)


def counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Trigram counts, a row for each text; none reaches over a text's end."""
    n = len(bounds) - 1
    if len(data) < 3:
        return np.zeros((n, BUCKETS), dtype=np.int64)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    inside = owner[:-2] == owner[2:]
    return np.bincount((owner[:-2] * BUCKETS + trigrams(data))[inside], minlength=n * BUCKETS).reshape(n, BUCKETS)


def learn(docs: DataFrame, teaches, max_rows: int = 1000, max_total: int = 20_000, max_chars: int = 20_000) -> tuple[list[str], np.ndarray]:
    """Languages in order of their names, and the probability of each bucket in each."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    own = own.filter(teaches(F.col("doc_id")) & F.col("lang").isNotNull() & F.length("text").between(3, max_chars))
    seen = own.groupBy("lang").count().collect()  # a row a language
    if not seen:
        return [], np.zeros((BUCKETS, 0))
    quota = max(1, min(max_rows, max_total // len(seen)))
    below = own.sparkSession.createDataFrame([(r["lang"], -(-SAMPLE_STEPS * quota // r["count"])) for r in seen], "lang string, below long")
    below = F.broadcast(below) if len(seen) <= BROADCAST_LANGS else below  # its size is known here
    drawn = own.join(below, "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_STEPS)) < F.col("below")).select("doc_id", "lang", "text")
    rows = drawn.distinct().limit(2 * max_total).collect()  # the share is drawn to give quota rows, give or take its root
    rows.sort(key=lambda r: (r["lang"], hash_order(r["doc_id"]), r["text"]))
    nth: dict[str, int] = {}
    rows = [r for r in rows if (nth.update({r["lang"]: nth.get(r["lang"], 0) + 1}) or nth[r["lang"]]) <= quota]
    langs = sorted({r["lang"] for r in rows})
    table = np.zeros((BUCKETS, len(langs)))
    for k, lang in enumerate(langs):
        texts = [r["text"].encode("utf-8", "surrogatepass") for r in rows if r["lang"] == lang]
        for i in range(0, len(texts), 64):
            part = texts[i : i + 64]
            table[:, k] += counts(np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)])).sum(axis=0)
    return langs, (table + 0.5) / (table + 0.5).sum(axis=0)


def fit(weight: np.ndarray, p: np.ndarray, start: np.ndarray, first: np.ndarray, total: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each text. weight and p: of its buckets, with columns the languages that it may
    hold; start: text of each bucket; first: each text's first bucket."""
    share = np.full((len(first), p.shape[1]), 1 / p.shape[1])
    for _ in range(rounds):
        part = share[start] * p
        part *= (weight / part.sum(axis=1))[:, None]
        share = np.add.reduceat(part, first, axis=0) / total[:, None]
    return share, np.add.reduceat(weight * np.log((share[start] * p).sum(axis=1)), first)


def infer(table: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and proportions (-1 outside the chosen set) of each text with at least one trigram; p: bucket by
    language."""
    text, bucket = np.nonzero(table)
    weight = table[text, bucket].astype(float)
    first = np.searchsorted(text, np.arange(len(table)))
    total = np.add.reduceat(weight, first)
    of = p[bucket]
    single = np.add.reduceat(weight[:, None] * np.log(of), first, axis=0)
    share, full = fit(weight, of, text, first, total)
    mixed = (share[text] * of).sum(axis=1)
    gain = np.add.reduceat(of * (weight / mixed)[:, None], first, axis=0) / total[:, None]
    most = full + total * np.log(np.maximum(gain.max(axis=1), 1.0))  # of any mixture
    order = np.argsort(-share, axis=1, kind="stable")
    best = np.argmax(single, axis=1)
    value = single[np.arange(len(best)), best]
    score = 1 / np.exp(single - value[:, None]).sum(axis=1)
    chosen = np.full(share.shape, -1.0)
    chosen[np.arange(len(best)), best] = 1.0
    for k in range(2, p.shape[1] + 1):
        penalty = PENALTY * (k - 1) * np.log(total + 1)
        worth = np.nonzero(most - penalty > value)[0]
        if not len(worth):
            break
        mine = np.isin(text, worth)
        local = np.searchsorted(worth, text[mine])
        held = order[worth, :k]
        begin = np.searchsorted(local, np.arange(len(worth)))
        shares, like = fit(weight[mine], np.take_along_axis(of[mine], held[local], axis=1), local, begin, total[worth])
        like -= penalty[worth]
        better = like > value[worth]
        now = worth[better]
        value[now] = like[better]
        top = np.argmax(shares[better], axis=1)
        best[now] = held[better][np.arange(len(now)), top]
        score[now] = shares[better][np.arange(len(now)), top]
        chosen[now] = -1.0
        chosen[now[:, None], held[better]] = shares[better]
    return best, score, chosen


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], held_out) -> DataFrame:
    """lang_pred, score, and the chosen languages with their proportions, of every text."""
    langs, p = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = flat(batch.column(2))
            n = len(bounds) - 1
            named, score, chosen = np.full(n, -1), np.zeros(n), np.full((n, len(langs)), -1.0)
            letters = np.fromiter((bool(t) and LETTER.search(t) is not None for t in batch.column(2).to_pylist()), bool, n)
            if langs:
                for i, j in runs(bounds, CHUNK):
                    for a in range(i, j, 400):
                        b = min(j, a + 400)
                        part = counts(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                        some = np.nonzero(part.any(axis=1))[0]
                        named[a:b], score[a:b], chosen[a:b] = 0, 1 / len(langs), 1 / len(langs)
                        if len(some):
                            named[a + some], score[a + some], chosen[a + some] = infer(part[some], p)
            named[~letters], score[~letters], chosen[~letters] = -1, 0.0, -1.0
            pred = [langs[k] if k >= 0 else "und" for k in named.tolist()]
            ranked = np.argsort(-chosen, axis=1, kind="stable")
            parts = [[k for k in own if row[k] >= 0] for own, row in zip(ranked.tolist(), chosen.tolist())]
            sets = pa.array([[langs[k] for k in own] for own in parts], pa.list_(pa.string()))
            shares = pa.array([[row[k] for k in own] for own, row in zip(parts, chosen.tolist())], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score), sets, shares], [c.split()[0] for c in PREDICTED.split(", ")])

    prepare(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ids.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text").mapInArrow(run, PREDICTED)
