import random
import zlib

import pytest
from pyspark.sql import functions as F

from stratakv.llm import quality_zstd as q

from .conftest import EDGES, prose


def junk(rng):
    return rng.choice([lambda: " ".join(prose(rng, n=1).upper() + "!!" for _ in range(80)), lambda: "*** ".join(prose(rng, n=80).split()), lambda: " ".join(["Same"] * 90)])()


@pytest.fixture(scope="module")
def data(spark, make_docs):
    rng = random.Random(1)
    rows = [(100 + i, junk(rng) if i % 4 == 0 else prose(rng)) for i in range(400)]
    labels = [(100 + i, int(i % 4 != 0), 0) for i in range(400)] + [(None, 1, 0), (5, None, 0), (6, 7, 0), (10**9, 1, 0)]
    return make_docs(rows + EDGES), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_edges(data):
    docs, labels = data
    model = q.train(docs, labels, lambda i: q.fold(i, 5) != 0)
    out = q.score(docs, model, lambda i: q.fold(i, 5) == 0).collect()
    assert len(out) == docs.count()
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= q.CUT)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in out if r.doc_id and r.doc_id >= 100 and r.held_out]
    assert sum(r.predicted == int((r.doc_id - 100) % 4 != 0) for r in held) >= 0.95 * len(held)
    kept = q.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in out)


def test_nothing_to_learn_from(spark, data):
    docs, labels = data
    everything = lambda i: F.lit(True)
    for some, score in ((labels.limit(0), 0.5), (labels.filter("quality = 1").limit(3), None)):
        out = q.score(docs, q.train(docs, some, everything), everything).collect()
        assert len({r.score for r in out}) == 1 and (score is None or out[0].score == score)
        assert score is not None or out[0].score > 0.5
    empty = docs.limit(0)
    assert q.score(empty, q.train(empty, labels, everything), everything).collect() == []


def test_whole_texts_count(data):
    docs, labels = data
    model = q.train(docs, labels, lambda i: q.fold(i, 5) != 0)
    good, bad = q._compressor(model.good), q._compressor(model.bad)
    rng = random.Random(2)
    start = prose(rng, n=2000)
    a, b = q.features([start + prose(rng, n=4000), start + " ".join(["SHOUT!!"] * 4000)], good, bad)
    assert a > b


def test_long_texts_and_repeats_take_no_place_from_those_that_teach(spark, make_docs):
    rng = random.Random(7)
    rows = [(k, prose(rng, n=4000)) for k in range(200)] + [(1000 + i, junk(rng) if i % 2 else prose(rng)) for i in range(120)] + [(500, prose(rng))] * 300
    labels = spark.createDataFrame([(r[0], int(r[0] % 2 == 0), 0) for r in rows], "doc_id long, quality int, toxic int")
    model = q.train(make_docs(rows), labels, lambda i: F.lit(True), max_rows=40)
    assert model.good and model.bad and model.slope > 0
    out = {r.doc_id: r.predicted for r in q.score(make_docs(rows), model, lambda i: F.lit(False)).collect()}
    assert sum(out[1000 + i] == (i + 1) % 2 for i in range(120)) >= 100
