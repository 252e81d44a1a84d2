import random
import re

import corpus_pipeline
from stratakv.llm import pii, registry

from .conftest import prose
from .test_ngram_trie import brute
from .test_quality import junk
from .test_suffix_dedup import cover


def test_stages_on_their_own_inputs(spark, make_docs, tmp_path):
    rng = random.Random(1)
    texts = [prose(rng, n=rng.randrange(20, 160)) for _ in range(120)]
    passage = prose(rng, n=60)
    for k in range(0, 30, 3):
        texts[k] += " " + passage + " " + prose(rng, n=5)
    near = [t.split() for t in texts[30:60]]
    for words in near:
        words[len(words) // 2] = "changed"
    rows = list(enumerate(texts + [" ".join(w) for w in near] + texts[60:70]))
    rows += [(500 + k, junk(rng)) for k in range(60)] + [(600, f"{prose(rng)} ab@mail.example.com {prose(rng)}"), (601, ""), (602, None), (None, prose(rng))]
    docs = make_docs(rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 500)) for i, _ in rows if i is not None], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    now = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "personal_data", "packing"]
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        if name != "packing":
            assert out.schema == docs.schema
        before = [(r.doc_id, r.text) for r in now.collect()]
        out.write.parquet(f"{sf}/stage{k}")
        now = spark.read.parquet(f"{sf}/stage{k}")
        after = [tuple(r)[:2] for r in now.collect()]
        if name == "quality":
            assert sum(i is not None and 500 <= i < 560 for i, _ in after) <= 6
            assert sum(i is not None and i < 160 for i, _ in after) >= 158
        elif name == "near_duplicates":
            component = {eval(x)[0]: eval(x)[2] for x in brute(before, 5, 80, 100)}
            assert sorted(map(repr, after)) == sorted(repr(x) for x in before if component[x[0]] == x[0])
        elif name == "repeats":
            raw = [(t or "").encode() for _, t in before]
            left = {i: sum(not g for g in gone) for (i, _), gone in zip(before, cover(raw, 200))}
            assert all(len((t or "").encode()) >= left[i] and len((t or "").encode()) - left[i] <= 8 for i, t in after)
            assert not any(passage in (t or "") for _, t in after)
        elif name == "personal_data":
            assert sorted(map(repr, after)) == sorted(repr((i, pii.mask(t))) for i, t in before)
            assert not any("@mail" in (t or "") for _, t in after)
        else:
            assert {i for i, _ in after} == {i for i, _ in before}
        kept[name] = len(after)
    assert corpus_pipeline.run(spark, sf).count() == kept["packing"]


def test_registry_names():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [sum(bool(re.match(rf"op{n}_", x)) for x in names) for n in range(1, 11)] == [1] * 10
    assert "pipeline" in names and set(registry.oracle_sql()) <= set(names)


def test_one_row_stays_of_each_class(spark, make_docs):
    rng = random.Random(5)
    t = [prose(rng) for _ in range(8)]
    near = " ".join([*t[3].split()[:-1], "changed"])
    rows = [(1, t[0])] * 3 + [(1, t[1])]  # repeats, and another text of their id
    rows += [(None, t[2])] * 3  # repeats without an id
    rows += [(2, t[3]), (7, near), (7, t[4]), (None, near)]  # of id 7 one text is near another's
    rows += [(8, t[5]), (None, t[5]), (9, t[6]), (9, t[6]), (5, t[6]), (5, t[6])]
    rows += [(10, ""), (10, ""), (11, None), (None, None), (None, t[7])]
    docs = make_docs(rows)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.schema == docs.schema
    want = [(1, t[0]), (1, t[1]), (None, t[2]), (2, t[3]), (7, t[4]), (8, t[5]), (5, t[6]), (10, ""), (10, ""), (11, None), (None, None), (None, t[7])]
    assert sorted(repr(tuple(r)[:2]) for r in out.collect()) == sorted(map(repr, want))
    assert {tuple(map(str, r)) for r in out.collect()} <= {tuple(map(str, r)) for r in docs.collect()}
    assert corpus_pipeline.near_duplicates(spark, make_docs([]), "").collect() == []
