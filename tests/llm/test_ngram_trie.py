import random
import re
import time

import numpy as np
import pytest

from stratakv.llm import components, ngram_trie, workdir

from .conftest import EDGES, prose


def brute(rows, n, num, den):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset() if not words else frozenset([tuple(words)]) if len(words) < n else frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids and sets[i] else doc_id, links[i]))
    return sorted(map(repr, out))


def corpus(seed):
    rng = random.Random(seed)
    rows = list(EDGES)
    passage = prose(rng, n=60)
    for k in range(60):
        text = prose(rng, n=rng.randrange(5, 150)) + (" " + passage if k % 3 == 0 else "")
        rows.append((100 + 10 * k, text))
        if k % 2:
            rows.append((101 + 10 * k, text.upper() if k % 4 == 1 else text))
        for c in range(k % 5):
            words = text.split()
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(1000)}"
            rows.append((102 + 10 * k + c, " ".join(words)))
    base = prose(rng, n=200).split()  # a large group of near copies, and chains of ever farther ones
    for c in range(60):
        words = list(base)
        words[rng.randrange(200)] = f"near{c}"
        rows.append((2000 + c, " ".join(words)))
    for c in range(40):
        base[5 * c % 200] = f"chain{c}"
        rows.append((3000 + c, " ".join(base)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100)])
@pytest.mark.parametrize("group,block", [(1000, 2_000_000), (3, 600)])
def test_against_brute_force(make_docs, monkeypatch, n, num, den, group, block):
    monkeypatch.setattr(ngram_trie, "GROUP", group)
    monkeypatch.setattr(ngram_trie, "BLOCK_GRAMS", block)
    rows = corpus(n)
    got = ngram_trie.near_classes(make_docs(rows), n, num, den).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows, n, num, den)


def test_empty_table_and_long_text(make_docs):
    assert ngram_trie.near_classes(make_docs([]), 3, 90, 100).collect() == []
    rng = random.Random(7)
    long = prose(rng, n=300_000)
    rows = [(1, long), (2, long + " end"), (3, long[: len(long) // 2])]
    got = sorted(map(tuple, ngram_trie.near_classes(make_docs(rows), 3, 90, 100).collect()))
    assert got == sorted(eval(x) for x in brute(rows, 3, 90, 100))


@pytest.mark.parametrize("cells", [8 << 20, 300])
def test_trees_find_all_links(monkeypatch, cells):
    monkeypatch.setattr(ngram_trie, "CELLS", cells)
    rng = np.random.default_rng(3)
    for _ in range(30):
        base = [np.unique(rng.integers(0, 1 << 40, rng.integers(1, 60)).astype(np.uint64)) for _ in range(6)]
        sets = []
        for b in base:
            for _ in range(rng.integers(1, 6)):
                own = b.copy()
                own[rng.integers(0, len(own), max(1, len(own) // 15))] = rng.integers(0, 1 << 40, max(1, len(own) // 15)).astype(np.uint64)
                sets.append(np.unique(own))
        copies = rng.integers(1, 5, len(sets))
        links = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))
        for sides in (np.full(len(sets), 2), rng.integers(0, 2, len(sets))):
            up, count = list(range(len(sets))), np.zeros(len(sets), dtype=int)
            for i in range(len(sets)):
                for j in range(len(sets)):
                    if i != j and (sides[0] == 2 or sides[i] != sides[j]) and links(i, j):
                        count[i] += copies[j]
                        up = [min(up[i], up[j]) if x in (up[i], up[j]) else x for x in up]
            forest, got = ngram_trie.tree_join(sets, copies, sides, 85, 100)
            assert got.tolist() == count.tolist()
            own = list(range(len(sets)))
            for i, j in forest:
                assert own[i] != own[j] and links(i, j)
                own = [min(own[i], own[j]) if x in (own[i], own[j]) else x for x in own]
            assert own == up


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, 500 + k) for k in range(100)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(80)] + [(5, 5), (3, 2), (2, 3)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).df.collect()))
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "a long, b long")).df.count() == 0


def test_many_rows_without_ids(make_docs):
    rng = random.Random(9)
    pairs = []
    for _ in range(2500):
        words = prose(rng, n=40).split()
        pairs += [(None, " ".join(words)), (None, " ".join([*words, "end"]))]
    rows = pairs * 2
    got = ngram_trie.near_classes(make_docs(rows), 3, 90, 100).collect()
    assert len(got) == 10_000 and all(r.component_id is None for r in got)
    assert {r.n_links for r in got} == {3}  # its own copy, and both of the longer or shorter text


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])
def test_many_unlike_texts_of_one_line_are_not_proposed(make_docs, monkeypatch, n, num):
    """More sets than GROUP meet in the n-grams of a line; only the near copies among them go on to the trees."""
    monkeypatch.setattr(ngram_trie, "GROUP", 30)
    rng = random.Random(4)
    line = " ".join(f"line{k}" for k in range(60))
    rows = [(i, f"{line} " + " ".join(f"own{i}x{k}" for k in range(60 + i % 40))) for i in range(300)]
    rows += [(1000 + i, f"{rows[i][1]} end{i}") for i in range(0, 300, 10)]
    rng.shuffle(rows)
    scratch = workdir.Scratch()
    docs = make_docs(rows).select("doc_id", "text")
    reps = ngram_trie.signatures(docs, np.zeros(1 << ngram_trie.SKETCH_BITS, dtype=np.uint8), n, num, 100).selectExpr("doc_id", "key", "n_shingles", "prefix", "parity")
    reps = scratch.table(reps, "reps")
    met = reps.selectExpr("explode(prefix) as token").groupBy("token").count().filter("count > 30").count()
    assert met > 0  # so that the blocks are met with
    ids = {r.key: r.doc_id for r in reps.collect()}
    pairs = {tuple(sorted((ids[r.a], ids[r.b]))) for r in ngram_trie.proposals(reps, num, 100, scratch).collect()}
    scratch.drop()
    assert {(i, 1000 + i) for i in range(0, 300, 10)} <= pairs
    assert len(pairs) < 60


def test_levels_tell_small_shares_in_large_tables():
    rng = np.random.default_rng(1)
    for mean in (0, 2, 100, 1200, 6000):
        total = rng.poisson(mean, 1 << 16).astype(np.uint64)
        total[:50] += np.uint64(4 * mean + 100)
        level = ngram_trie.counter_levels(total)
        assert (level[:50] > 0).all() and (level[50:] == 0).mean() > 0.999


def test_shuffle_files_go_with_the_step(spark):
    files = lambda: sum("shuffle_" in str(f) for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before = files()
    kept = [spark.range(1000).repartition(4), spark.range(100).selectExpr("id % 7 as a").groupBy("a").count()]
    tables = [workdir.Table(df, "freed") for df in kept]
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert [t.df.count() for t in tables] == [1000, 7]
    assert [df.count() for df in kept] == [1000, 7]
