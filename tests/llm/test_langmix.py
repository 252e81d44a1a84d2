import random
import zlib

from pyspark.sql import functions as F

from stratakv.llm import langmix
from stratakv.llm.quality_zstd import fold

from .conftest import EDGES, prose


def test_held_out_languages_and_edges(make_docs):
    rng = random.Random(1)
    rows = [(100 + k, prose(rng, lang, rng.randrange(8, 200)), lang) for k in range(300) for lang in [("en", "fr", "de")[k % 3]]]
    rows += [(500, "12345 !!! ...", "en"), (501, prose(rng, "fr", 90) + " " + prose(rng, "de", 20), None), (502, prose(rng, "de", 20_000), None)] + [(*r, None) for r in EDGES]
    docs = make_docs(rows)
    model = langmix.learn(docs, lambda i: fold(i, 4) != 2)
    assert model[0] == ["de", "en", "fr"] and abs(model[1].sum(axis=0) - 1).max() < 1e-9
    out = langmix.predict(docs, model, lambda i: fold(i, 4) == 2).collect()
    assert len(out) == len(rows)
    true = {r[0]: r[2] for r in rows}
    held = [r for r in out if r.held_out and 100 <= r.doc_id < 500]
    assert sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.97 * len(held)
    by_id = {r.doc_id: r for r in out}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert by_id[501].lang_pred == "fr" and 0.6 < by_id[501].score < 0.97 and by_id[502].lang_pred == "de"
    assert [by_id[k].lang_pred for k in (1, 2, 3, 500)] == ["und"] * 4 and by_id[500].score == 0
    assert by_id[4].lang_pred in model[0] and all(0 <= r.score <= 1 for r in out)
    # a language's name, a source or an id changes nothing
    again = langmix.predict(docs.withColumn("lang", F.lit("zz")).withColumn("doc_id", F.col("doc_id") + 7), model, lambda i: fold(i, 4) == 2).collect()
    assert sorted((r.lang_pred, r.score) for r in again) == sorted((r.lang_pred, r.score) for r in out)


def test_nothing_learned(make_docs):
    docs = make_docs([(1, "some text", "en"), (2, "more", None)])
    out = langmix.predict(docs, langmix.learn(docs.limit(0), lambda i: fold(i, 4) != 2), lambda i: fold(i, 4) == 2).collect()
    assert {(r.lang_pred, r.score) for r in out} == {("und", 0.0)}
    assert langmix.predict(make_docs([]), langmix.learn(docs, lambda i: F.lit(True)), lambda i: F.lit(True)).collect() == []


def test_more_languages_cost_likelihood():
    import numpy as np

    p = np.array([[0.7, 0.1], [0.1, 0.7], [0.2, 0.2]])
    best, score, chosen = langmix.infer(np.array([[50, 7, 14], [300, 200, 100], [7, 50, 14]]), p)
    assert best.tolist() == [0, 0, 1] and score[0] > 0.99 and 0.5 < score[1] < 0.9
    assert (chosen[0] == [1, -1]).all() and (chosen[1] > 0).all() and abs(chosen[1].sum() - 1) < 1e-9 and chosen[1].argmax() == 0


def test_letters_sets_and_repeats(make_docs):
    rng = random.Random(3)
    rows = [(100 + k, prose(rng, lang, 60), lang) for k in range(90) for lang in [("en", "fr", "de")[k % 3]]] + [(90, "the same row", "en")] * 200
    model = langmix.learn(make_docs(rows), lambda i: F.lit(True), max_rows=20)
    rows = [(1, "½", None), (2, "²²", None), (3, "Ⅷ", None), (4, "½ é", None), (5, prose(rng, "fr", 300) + " " + prose(rng, "de", 150), None), (6, prose(rng, "en", 100), None)]
    rows.append((7, prose(rng, "fr", 20_000) + " " + prose(rng, "de", 300), None))  # 1.5 percent of a long text
    by_id = {r.doc_id: r for r in langmix.predict(make_docs(rows), model, lambda i: F.lit(False)).collect()}
    assert [by_id[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and by_id[4].lang_pred != "und" and by_id[1].languages == []
    assert by_id[5].languages == ["fr", "de"] and by_id[6].languages == ["en"] and by_id[6].proportions == [1.0]
    assert set(by_id[7].languages) >= {"fr", "de"} and by_id[7].languages[0] == "fr"
    for r in by_id.values():
        assert len(r.languages) == len(r.proportions) and r.proportions == sorted(r.proportions, reverse=True) and (not r.languages or abs(sum(r.proportions) - 1) < 1e-6)
