"""Quality rules from built-in functions alone: base counts, and divergence from language references.

Every text gives two histograms: its character classes (upper-case letters, digits, marks, white space, the rest) and,
for each language, that language's `COMMON` commonest words and all other words. A language's words are counted over all
rows of that language, ties going to the word that sorts first; its reference is the sum of the histograms of those rows.
The text's divergence from a language is the mean of the two Jensen-Shannon distances (the square root of the divergence
in bits, 0 to 1); its verdict looks at the nearest language. Texts of fewer than `MIN_WORDS` words are too short for a
histogram and are not judged by it.

The words are counted first, in one pass over the texts that combines before its shuffle; the features are written once
in a second pass, one narrow row a document. Every language has its reference: up to `MOST_LANGS` the plan holds them as
literals, more as arrays of about `BLOCK_LANGS` languages each (under two megabytes), so the work is rows times languages,
and the driver holds `COMMON` words a language.

Defined cases: a null text has no words and fails the base rules, and so does an empty one; a null language adds to no
reference; without any reference the divergence is null and nobody is rejected by it; a null id stays null; repeated rows
are judged each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workdir import Table

MIN_WORDS = 40
MOST_LANGS, BLOCK_LANGS = 64, 4096
#: A text of n words is kept up to a distance of FAR + SHORT / sqrt(n): few words scatter more.
FAR, SHORT = 0.17, 0.7
SYMBOLS = "#*$%&|<>"
SPACE = r"[\x20\x09-\x0D]+"

COMMON = 13  # words of a language
SALTS = 16  # parts in which a language's words are ranked first
FIRST_CODE = 0x100  # code point of the first common word's character


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, window: int = 5) -> Column:
    """Number of words that lie in a window which occurs at least twice."""

    def of_hashes(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            same = lambda i, j: s[i]["h"] == s[j]["h"]
            last = F.size(s) - 1
            hit = F.filter(F.sequence(F.lit(0), last), lambda i: F.when((i > 0) & same(F.greatest(i - 1, F.lit(0)), i), True).when((i < last) & same(i, F.least(i + 1, last)), True).otherwise(False))
            return F.sort_array(F.transform(hit, lambda i: s[i]["i"]))

        def covered(p: Column) -> Column:
            gaps = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.least(p[i] - p[i - 1], F.lit(window)))
            return F.aggregate(gaps, F.lit(window), lambda a, x: a + x)

        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(let(ordered, of_sorted), covered)).otherwise(F.lit(0))

    def of_words(w: Column) -> Column:
        at = lambda i, k: w[i + k]
        return F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[at(i, k) for k in range(window)]))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > window, let(let(hashed, of_words), of_hashes)).otherwise(F.lit(0)).cast("long")


def common_words(docs: DataFrame, n: int = COMMON) -> DataFrame:
    """lang, word, count: the n words that are most frequent in a language's rows. Ranked in parts first, so that no task
    holds a language's words."""
    own = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and text is not null")
    counts = own.select("lang", F.explode(F.split("text", SPACE)).alias("word")).filter("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("count"))
    for by in (["lang", F.pmod(F.xxhash64("word"), F.lit(SALTS))], ["lang"]):
        first = Window.partitionBy(*by).orderBy(F.desc("count"), "word")
        counts = counts.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= n).drop("nth")
    return counts


def coded(words: list[str]) -> Column:
    """A character for each word, so that counting a word is counting a character; the code points of halves of pairs are
    left out."""
    point = lambda k: FIRST_CODE + k if FIRST_CODE + k < 0xD800 else FIRST_CODE + k + 0x800
    return F.create_map(*[F.lit(x) for k, w in enumerate(words) for x in (w, chr(point(k)))]) if words else F.create_map().cast("map<string,string>")


def features(docs: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, lang, base counts, the histogram of character classes, and the text's common words as characters."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = own.select(
        "doc_id", "lang",
        F.array_remove(F.split("text", SPACE), "").alias("words"),
        F.length("text").alias("chars"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.regexp_replace("text", r"[\p{Ll}\x20\x09-\x0D]+", "").alias("rest"),  # the few characters that most counts are about
    )
    left = lambda pattern: F.length(F.regexp_replace("rest", pattern, ""))
    step = step.withColumns({"n_symbols": left(f"[^{SYMBOLS}]+").cast("long"), "upper": left(r"[^\p{Lu}]+"), "digits": left(r"[^0-9]+"), "marks": left(r"[\p{L}\p{N}\p{M}\x20\x09-\x0D]+")})
    code = coded(words)
    common = F.array_join(F.transform(F.filter("words", lambda w: w.isin(words)), lambda w: code[w]), "") if words else F.lit("")
    step = step.withColumns({"n_words": F.size("words").cast("long"), "word_chars": F.length(F.array_join("words", "")).cast("long"), "n_repeat_words": repeat_words(F.col("words")), "common": common})
    white = F.col("chars") - F.col("word_chars")
    classes = [F.col("upper"), F.col("digits"), F.col("marks"), white, F.col("chars") - F.col("upper") - F.col("digits") - F.col("marks") - white]
    return step.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.array(*[x.cast("long") for x in classes]).alias("char_hist"), "common")


def times(code: Column) -> Column:
    """How often a character is among the common words of a row."""
    return F.length("common") - F.length(F.replace("common", code, F.lit("")))


def shares(hist: Column) -> Column:
    """A histogram of counts as shares of its sum; null if it is empty."""
    real = hist.cast("array<double>")
    total = F.aggregate(real, F.lit(0.0), lambda a, y: a + y)
    return F.when(total > 0, let(total, lambda t: F.transform(real, lambda x: x / t)))


def distance(p: Column, q: list[float] | Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    parts = F.zip_with(p, q if isinstance(q, Column) else F.array(*map(F.lit, q)), lambda a, b: let((a + b) / 2, lambda m: (term(a, m) + term(b, m)) / 2))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, y: a + y), F.lit(0.0)))


def references(rows: DataFrame, common: DataFrame, words: list[str]) -> DataFrame:
    """lang, c, codes, w: a language's character classes as shares, its words' characters, and the shares of the words and
    of all others. Languages without any word have none."""
    code = coded(words)
    listed = F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("less"), "word")))
    tops = common.groupBy("lang").agg(listed.alias("top"))
    sums = rows.filter(F.col("lang").isNotNull()).groupBy("lang").agg(F.array(*[F.sum(F.col("char_hist")[i]) for i in range(5)]).alias("chars"), F.sum("n_words").alias("n"))
    counts = F.transform("top", lambda x: -x["less"])
    others = F.col("n") - F.aggregate(counts, F.lit(0).cast("long"), lambda a, y: a + y)
    return sums.join(tops, "lang").select("lang", shares(F.col("chars")).alias("c"), F.transform("top", lambda x: code[x["word"]]).alias("codes"), shares(F.concat(counts, F.array(others))).alias("w"))


def judge(docs: DataFrame, min_words: int = MIN_WORDS, far: float = FAR, short: float = SHORT) -> DataFrame:
    """Base counts, base_failed, kept, and the divergence that kept rests on."""
    common = Table(common_words(docs), "common-words").df
    words = sorted(r["word"] for r in common.select("word").distinct().collect())
    rows = Table(features(docs, words), "rule-features").df
    known = Table(references(rows, common, words), "rule-references").df  # a row a language
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    if len(few := known.orderBy("lang").limit(MOST_LANGS + 1).collect()) <= MOST_LANGS:
        codes = sorted({c for r in few for c in r["codes"]})
        at = {c: i for i, c in enumerate(codes)}
        both = F.struct(shares(F.col("char_hist")).alias("c"), F.array(*[times(F.lit(c)) / n for c in codes]).alias("h"), F.lit(0.0).alias("none"))

        def away(x: Column, r) -> Column:
            own = [x["h"][at[c]] for c in r["codes"]]
            rest = 1.0 - sum(own, x["none"])
            return (distance(x["c"], r["c"]) + distance(F.array(*own, rest), r["w"])) / 2

        apart = let(both, lambda x: F.least(*[away(x, r) for r in few] * (2 if len(few) == 1 else 1))) if few else F.lit(None).cast("double")
    else:
        blocks = -(-known.count() // BLOCK_LANGS)
        held = {f"refs{b}": known.filter(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == b).agg(F.collect_list(F.struct("c", "codes", "w"))).scalar() for b in range(blocks)}
        rows = rows.withColumns(held)
        own = lambda r: F.transform(r["codes"], lambda c: times(c) / n)
        full = lambda h: F.concat(h, F.array(1.0 - F.aggregate(h, F.lit(0.0), lambda a, y: a + y)))
        least = lambda x, refs: F.array_min(F.transform(refs, lambda r: (distance(x, r["c"]) + distance(let(own(r), full), r["w"])) / 2))
        apart = let(shares(F.col("char_hist")), lambda x: F.array_min(F.array(*[least(x, F.col(refs)) for refs in held])))
    judged = rows.withColumn("divergence", F.when(F.col("n_words") >= min_words, apart))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~F.coalesce(F.col("divergence") > far + short / F.sqrt("n_words"), F.lit(False))).alias("kept"), "divergence")


def verdicts(docs: DataFrame) -> DataFrame:
    return judge(docs).drop("divergence")


def _oracle() -> str:
    sums = lambda name, n: "[" + ", ".join(f"sum({name}[{i}])" for i in range(1, n + 1)) + "]"

    def dist(p: str, q: str) -> str:
        share = f"list_transform(list_zip({p}, {q}), lambda z: [z[1] / list_sum({p}), z[2] / list_sum({q})])"
        term = lambda k: f"CASE WHEN z[{k}] > 0 THEN z[{k}] * log2(z[{k}] / ((z[1] + z[2]) / 2)) ELSE 0 END"
        return f"sqrt(greatest(list_sum(list_transform({share}, lambda z: ({term(1)} + {term(2)}) / 2)), 0))"

    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (
  SELECT k, generate_subscripts(ws, 1) AS i, unnest(ws) AS w
  FROM (SELECT k, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d)
),
n AS (SELECT k, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY k),
wl AS (SELECT lang, w, count(*) AS c FROM w JOIN d USING (k) WHERE lang IS NOT NULL GROUP BY lang, w),
top AS MATERIALIZED (SELECT lang, w, c, nth FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY c DESC, w) AS nth FROM wl) WHERE nth <= {COMMON}),
dw AS MATERIALIZED (SELECT k, w, count(*) AS c FROM w WHERE w IN (SELECT w FROM top) GROUP BY k, w),
win AS (
  SELECT k, i, w || chr(31) || lead(w, 1) OVER o || chr(31) || lead(w, 2) OVER o || chr(31) || lead(w, 3) OVER o || chr(31) || lead(w, 4) OVER o AS five
  FROM w WINDOW o AS (PARTITION BY k ORDER BY i)
),
rep AS (
  SELECT k, count(DISTINCT i + j) AS n_repeat_words
  FROM (SELECT k, i, count(*) OVER (PARTITION BY k, five) AS c FROM win WHERE five IS NOT NULL), range(5) AS r(j)
  WHERE c > 1 GROUP BY k
),
lines AS (
  SELECT k, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT k, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY k
),
f AS MATERIALIZED (
  SELECT d.k, doc_id, lang, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    CAST(length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g')) AS DOUBLE) AS up, CAST(length(regexp_replace(text, '[^0-9]+', '', 'g')) AS DOUBLE) AS dig,
    CAST(length(regexp_replace(text, '[\\p{{L}}\\p{{N}}\\p{{M}}\\x20\\x09-\\x0D]+', '', 'g')) AS DOUBLE) AS marks, CAST(length(text) AS DOUBLE) AS chars
  FROM d LEFT JOIN n USING (k) LEFT JOIN rep USING (k) LEFT JOIN lines USING (k)
),
h AS MATERIALIZED (SELECT *, [up, dig, marks, chars - word_chars, word_chars - up - dig - marks] AS ch FROM f),
refs AS MATERIALIZED (
  SELECT lang, any_value(rc) AS rc, list(c ORDER BY nth) || [any_value(t) - sum(c)] AS rw
  FROM top JOIN (SELECT lang, {sums("ch", 5)} AS rc, sum(n_words) AS t FROM h WHERE lang IS NOT NULL GROUP BY lang) USING (lang) GROUP BY lang
),
own AS (
  SELECT h.k, t.lang, list(coalesce(dw.c, 0) ORDER BY nth) || [any_value(h.n_words) - sum(coalesce(dw.c, 0))] AS wh
  FROM h CROSS JOIN (SELECT lang, w, nth FROM top) t LEFT JOIN dw ON dw.k = h.k AND dw.w = t.w WHERE h.n_words >= {MIN_WORDS} GROUP BY h.k, t.lang
),
near AS (
  SELECT k, min(({dist("ch", "rc")} + {dist("CAST(wh AS DOUBLE[])", "CAST(rw AS DOUBLE[])")}) / 2) AS divergence FROM own JOIN h USING (k) JOIN refs ON refs.lang = own.lang GROUP BY k
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(divergence <= {FAR} + {SHORT} / sqrt(n_words), true) AS kept
FROM h LEFT JOIN near USING (k)
"""


ORACLE_SQL = _oracle()
