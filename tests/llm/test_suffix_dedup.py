import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from stratakv.llm import suffix_dedup as sd

from .conftest import EDGES, prose


def cover(texts, length):
    count = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p : p + length] = True
        out.append(gone)
    return out


def corpus(seed):
    rng = random.Random(seed)
    passages = [prose(rng, n=n) for n in (30, 45, 60, 200)] + ["é" * 250, "ab" * 200]
    rows = list(EDGES) + [(50, prose(rng, n=70))] * 2
    for k in range(60):
        parts = [prose(rng, n=rng.randrange(1, 80))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(max(1, len(p) // 3))
            parts += [p[a : len(p) - rng.randrange(max(1, len(p) // 4))], prose(rng, n=rng.randrange(1, 30))]
        rows.append((100 + k, " ".join(parts)))
    rows.append((99, "z" * 1000))
    return rows


def expected(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (doc_id, _), t, gone in zip(rows, texts, cover(texts, length)):
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        out.append((doc_id, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("chunk", [1 << 19, 700])
def test_against_brute_force(make_docs, monkeypatch, chunk):
    monkeypatch.setattr(sd, "BUCKET_ROWS", chunk)  # small: many buckets and ranges, so that most anchors are at an end
    rows = corpus(chunk)
    got = sd.digests(make_docs(rows)).collect()
    assert sorted(repr(tuple(r)) for r in got) == expected(rows, 200)


@pytest.mark.parametrize("seed", [5, 6])
def test_sql_against_brute_force(seed):
    rows = corpus(seed)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in rows])
    assert sorted(repr(r) for r in con.execute(sd.ORACLE_SQL).fetchall()) == expected(rows, 200)


def test_parts_of_long_texts(monkeypatch):
    monkeypatch.setattr(sd, "CHUNK", 512)
    rng = random.Random(3)
    data = np.frombuffer(prose(rng, n=1000).encode(), dtype=np.uint8)
    starts = set()
    for part, own, texts, base in sd.pieces(data, np.array([0, len(data)]), 200):
        text, place, before, after, *_ = sd.anchors(part, own, 200, 48)
        for p, b, a, k in zip(place, before, after, text):
            new = set(range(int(base[k] + p - b), int(base[k] + p - a) + 1))
            assert not new & starts
            starts |= new
    assert starts == set(range(len(data) - 199))


def test_equal_strings_have_equal_anchors():
    rng = random.Random(4)
    passage = prose(rng, n=100).encode()
    found = []
    for _ in range(4):
        data = np.frombuffer(prose(rng, n=rng.randrange(5, 50)).encode() + passage + prose(rng, n=20).encode(), dtype=np.uint8)
        at = bytes(data).index(passage)
        _, place, before, after, gram, _ = sd.anchors(data, np.array([0, len(data)]), 200, 48)
        where = {}
        for p, b, a, g in zip(place, before, after, gram):
            where.update({s - at: (int(p) - at, int(g)) for s in range(int(p - b), int(p - a) + 1)})
        found.append({s: w for s, w in where.items() if 0 <= s <= len(passage) - 200})
    assert all(f == found[0] for f in found) and len(found[0]) == len(passage) - 199


def test_multikey_order():
    rng = np.random.default_rng(5)
    for n in (0, 1, 50, 20_000):
        a, b = rng.integers(0, 20, n), rng.integers(0, 1000, n)
        got = sd.multikey_order([a, b], least=16)
        assert [(a[i], b[i]) for i in got] == sorted(zip(a, b))


def test_suffixes_meet_in_their_range(spark):
    rng = np.random.default_rng(6)
    split = np.array([[3, 5], [3, 9], [7, 0]])
    packs, own = [], []
    for bucket in range(5):
        held = np.zeros(60, dtype=sd.SUFFIX)
        held["lead"], held["whole"] = rng.integers(0, 9, 60), rng.integers(0, 12, 60)
        held = np.unique(held)  # one of each run
        held["gram"], held["around"], held["back"], held["again"] = 1, bucket, np.arange(len(held)) % 150, rng.integers(0, 5, len(held)) == 0
        cut = sd.ranges_of(held["lead"], held["whole"], split)
        packs += [(r, bytearray(held[cut[r] : cut[r + 1]].tobytes())) for r in range(4) if cut[r] < cut[r + 1]]
        own.append(held)
    every = np.concatenate(own)
    count = Counter(zip(every["lead"].tolist(), every["whole"].tolist()))
    want = {(int(x["around"]), int(x["back"])) for x in every if not x["again"] and count[int(x["lead"]), int(x["whole"])] > 1}
    got = set()
    for r in sd.range_repeats(spark.createDataFrame(packs, "range int, suffixes binary"), 3).collect():
        got |= {(r.around, 63 * w + b) for w in range(3) for b in range(63) if r[f"bits{w}"] >> b & 1}
    assert got == want


def test_deduplicated_texts(make_docs):
    rows = corpus(9)
    docs = make_docs(rows)
    out = sd.deduplicated(docs)
    assert out.schema == docs.schema
    texts = [(t or "").encode() for _, t in rows]
    want = []
    for (doc_id, text), raw, gone in zip(rows, texts, cover(texts, 200)):
        kept, at = [], 0
        for c in text or "":
            n = len(c.encode())
            if not gone[at : at + n].all():
                kept.append(c)
            at += n
        want.append((doc_id, None if text is None else "".join(kept)))
    got = out.collect()
    assert sorted(repr((r.doc_id, r.text)) for r in got) == sorted(map(repr, want))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert sd.deduplicated(make_docs([])).count() == 0 and sd.digests(make_docs([])).count() == 0


def test_equal_rows_give_their_spans_once(make_docs):
    text = prose(random.Random(8), n=400)
    docs = make_docs([(1, text)] * 300 + [(None, text)] * 300)
    own = docs.select(sd.row_key().alias("row_key"), "text")
    spans = sd.repeats(own).df.collect()
    assert len(spans) == 2 and all(len(r.spans) <= len(text) for r in spans)
    got = sd.digests(docs).collect()
    assert len(got) == 600 and {r.n_removed for r in got} == {len(text.encode())}
