import random

import pytest

WORDS = {
    "en": "the of and to in is that for it as with was on be at by this from house river stone light walk under between never always garden bridge story".split(),
    "fr": "de la le et les des en un une du que est pour dans qui sur pas au maison rivière pierre lumière marcher sous jamais toujours jardin pont histoire".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im nicht ein haus fluss stein licht gehen unter zwischen niemals immer garten brücke geschichte".split(),
}


def prose(rng: random.Random, lang: str = "en", n: int = 120) -> str:
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "", "", ",", "."]) for _ in range(n)).capitalize()


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents of (doc_id, text, ...) rows, with further columns whose names operators use themselves."""

    def make(rows, lang="en"):
        full = [(r[0], r[1], r[2] if len(r) > 2 else lang, "src", None if r[1] is None else len(r[1]), 1, "x", [1], 2.5) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, key int, score string, spans array<int>, row_key double").repartition(3)

    return make


#: Nulls in every column, empty and blank texts, odd characters, repeated rows.
EDGES = [(1, None), (2, ""), (3, " \n\t "), (None, "a text without an id"), (None, None), (4, "x"), (5, "x"), (5, "x"), (6, "é" * 300), (7, "日本語 テキスト 🎉"), (8, "\u0000 nul"), (9, "word " * 3)]
