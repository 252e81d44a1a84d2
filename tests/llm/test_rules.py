import random
import re
from collections import Counter

import duckdb

from stratakv.llm import js_rules

from .conftest import EDGES, prose


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside), n < 10 or 100 * len(inside) > 20 * n


def corpus():
    rng = random.Random(1)
    rows = list(EDGES)
    for k in range(60):
        lang = ("en", "fr", "de")[k % 3]
        rows.append((100 + k, prose(rng, lang, rng.randrange(1, 200)), lang))
    line = prose(rng, n=12)
    rows += [(300, "\n".join([line, "", " ", line, prose(rng), line, "", line + " "])), (301, "a b c d e " * 30), (302, "x y z a b c d e q r s a b c d e f g h")]
    rows += [(310, prose(rng, n=100).upper()), (311, "#|# ".join(prose(rng, n=100).split())), (312, " ".join(["12345"] * 3 + [str(rng.random()) for _ in range(80)])), (313, prose(rng, n=30_000)), (314, "no language", None)]
    return rows


def test_counts_against_brute_force(make_docs):
    rows = corpus()
    got = js_rules.judge(make_docs(rows)).collect()
    want = sorted(repr((r[0], *base(r[1]))) for r in rows)
    assert sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got) == want
    by_id = {r.doc_id: r for r in got}
    for k in range(100, 160):  # clean texts stay unless too short
        assert by_id[k].kept == (not by_id[k].base_failed)
    assert not any(by_id[k].kept for k in (310, 311, 312))
    assert all((r.divergence is None) == (r.n_words < js_rules.MIN_WORDS) for r in got)


def test_sql_agrees(spark, make_docs):
    docs = make_docs(corpus())
    con = duckdb.connect()
    frame = docs.select("doc_id", "text", "lang").toPandas()
    con.register("documents", frame)
    df = js_rules.verdicts(docs)
    answer = con.execute(js_rules.ORACLE_SQL)
    names = [d[0] for d in answer.description]
    assert names == df.columns
    plain = lambda r: repr(tuple(None if x != x else int(x) if isinstance(x, float) else x for x in r))
    assert sorted(map(plain, answer.fetchall())) == sorted(map(plain, df.collect()))


def test_no_references_and_no_rows(make_docs):
    out = js_rules.judge(make_docs([(1, prose(random.Random(2)), None)], lang=None)).collect()
    assert out[0].divergence is None and out[0].kept
    assert js_rules.verdicts(make_docs([])).collect() == []


def test_no_python_in_the_plan(make_docs):
    plan = js_rules.verdicts(make_docs(EDGES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_every_language_has_its_reference(make_docs, monkeypatch):
    rng = random.Random(4)
    odd = " ".join(f"{rng.randrange(10**6)}!?" for _ in range(400))
    rows = [(k, prose(rng), f"l{k % 70:02}") for k in range(140)] + [(999, odd, "zz"), (1000, prose(rng), None), (1001, "", "empty"), (1002, None, "none")]
    many = {r.doc_id: (r.kept, r.divergence) for r in js_rules.judge(make_docs(rows)).collect()}
    assert many[999][0] and many[999][1] < 1e-6
    monkeypatch.setattr(js_rules, "MOST_LANGS", 1000)
    few = {r.doc_id: (r.kept, r.divergence) for r in js_rules.judge(make_docs(rows[:20] + rows[-4:])).collect()}
    monkeypatch.setattr(js_rules, "MOST_LANGS", 2)
    monkeypatch.setattr(js_rules, "BLOCK_LANGS", 2)
    for r in js_rules.judge(make_docs(rows[:20] + rows[-4:])).collect():
        kept, divergence = few[r.doc_id]
        assert r.kept == kept and (r.divergence is None) == (divergence is None) and abs((r.divergence or 0) - (divergence or 0)) < 1e-9
