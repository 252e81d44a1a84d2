import math
import random

import pytest

from stratakv.llm import maxscore


def brute(rows, k, every):
    sound = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in sound]
    out = []
    for i, q in ints:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ints if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard,step,seed", [(7, 3, 13), (20, 8192, 5), (8192, 4, 2048)])
def test_against_brute_force(spark, monkeypatch, shard, step, seed):
    for name, value in (("SHARD_CELLS", 12 * shard), ("LEAST_ROWS", shard), ("STEP", step), ("SEED_ROWS", seed), ("BLOCK_CELLS", 48)):
        monkeypatch.setattr(maxscore, name, value)
    rng = random.Random(shard)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(12)]) for i in range(60)]
    rows += [(i, [0.25] * 12) for i in range(60, 90)]  # ties
    rows += [(90, [0.0] * 12), (91, [-0.5] * 12), (92, None), (93, [None] * 12), (94, [float("nan")] * 12), (95, [float("inf")] + [0.0] * 11), (None, [0.1] * 12), (60, [0.25] * 12), (96, [1.0]), (97, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, shard int, score string")
    import numpy as np

    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    vectors = maxscore.quantised(df)
    got = maxscore.top_k(vectors, vectors.filter("vec_id % 10 = 0"), 10).collect()
    assert sorted(map(tuple, got)) == brute(rows, 10, 10)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [0.5, -0.5]), (1, [-0.5, 0.5])], "vec_id long, embedding array<float>")
    vectors = maxscore.quantised(df)
    assert [tuple(r) for r in maxscore.top_k(vectors, vectors.filter("vec_id = 0")).collect()] == [(0, 1, 1, -2 * 512 * 512)]
    none = vectors.limit(0)
    assert maxscore.top_k(none, none).collect() == []


def test_rows_are_let_go():
    import numpy as np

    rng = np.random.default_rng(1)
    rows = np.zeros((5000, 40), dtype=np.int64)
    for r in rows:
        r[rng.integers(0, 40, 3)] = rng.integers(1, 100, 3)
    shard = maxscore.Shard(np.arange(5000), rows)
    q = np.zeros(40, dtype=np.int64)
    q[:6] = [1000, 500, 3, 2, 1, 1]
    own, score = shard.top(-1, q, 10)
    want = np.sort(rows @ q)[::-1][:10]
    assert sorted(score, reverse=True)[:10] == want.tolist() and len(own) < 200


def test_large_weights_stay_exact():
    import numpy as np

    rng = np.random.default_rng(2)
    rows = rng.integers(-(1 << 28), 1 << 28, (300, 16))
    assert maxscore.number_type(rows, rows) is np.int64 and maxscore.number_type(rows >> 20, rows >> 20) is np.float64
    for shift in (0, 20):
        own = rows >> shift
        shard = maxscore.Shard(np.arange(300), own, maxscore.number_type(own, own))
        found, score = shard.top(5, own[5], 10)
        every = np.delete(own @ own[5], 5)
        assert sorted(score.tolist(), reverse=True)[:10] == np.sort(every)[::-1][:10].tolist() and 5 not in found
