"""Small corpora with the awkward rows that every operator has to define a result for."""

from __future__ import annotations

import random

import pytest

SYLLABLES = {
    "en": "the and ing tion er ou wh th st ea re ly".split(),
    "fr": "le eau tion que oi ré ment eux elle è aux".split(),
    "de": "der ung sch heit ein ü ver pf ach ge keit".split(),
}
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, lang: str, words: int) -> str:
    parts = SYLLABLES[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang): three languages, copies, near copies, repeated text, nulls, empties, one long text."""
    rng = random.Random(11)
    rows = [(i, prose(rng, ("en", "en", "fr", "de")[i % 4], rng.randint(60, 200)), ("en", "en", "fr", "de")[i % 4]) for i in range(120)]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(5)]
    for i in range(10):
        words = rows[i][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((300 + i, " ".join(words), rows[i][2]))
    rows += [(400, None, "en"), (401, "", "en"), (402, "  \n\t", None), (403, "12 345 !!", "fr"), (404, "Word", None)]
    rows += [(405, "The WORD the word   naïve\x1cx", None), (406, prose(rng, "en", 20_000), "en")]
    rows += [(407, "same line here\n" * 40, "en")]
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus with two rows repeated and columns whose names operators use inside."""
    rows = [(d, t, lang, "src", len(t or ""), "x", 7, 1) for d, t, lang in corpus]
    schema = DOCUMENTS + ", block string, row_key int, n int"
    return spark.createDataFrame(rows + rows[3:5], schema).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)
