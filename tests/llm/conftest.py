"""Documents with every odd case: nulls, empties, long texts, ties, repeats, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, hit string, size long, spans string, comp long"
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["the", "of", "and", "river", "stone", "cloud", "walks", "Under", "bright", "seven", "quiet", "nothing", "éclair", "über", "niño", "it's"]
    return " ".join(rng.choice(words) + str(rng.randrange(40)) * (rng.random() < 0.5) for _ in range(n))


def documents() -> list[tuple]:
    a, b = prose(1, 80), prose(2, 400)
    texts = [
        a, a, a + " and more", b, b[: len(b) // 2], None, "", " \n\t", "1234 5678", "word", "two words", "a b c d e", "A B  C\nD E",
        PASSAGE, "Before " + PASSAGE.upper() + " behind", "alpha beta gamma. delta", prose(3, 5000), prose(4, 30) + "\n" + PASSAGE,
        "line one here\nline one here\nline two\n" * 6, "### *** $$$ a b c d e f g h i j k", "Apache License, Version 2.0. The GNU General  Public License; MIT license",
        "Licensed under the Apache License, Version 2.0 or cc by-sa 4.0", "日本語のテキスト。これは長い文です", "Привет мир, это русский текст", "😀 !!! ???", "x" * 3000,
        b.replace("river", "lake", 1), prose(5, 60) + " " + a, prose(6, 25), prose(6, 25),
    ]
    langs, sources = ["en", "fr", None, "de"], ["web", "books", None, "code"]
    rows = [(i, t, langs[i % 4], sources[i % 3], len(t or ""), 7, "x", None, "y", 3) for i, t in enumerate(texts)]
    rows.append((3, b, "en", "web", 1, 1, None, 1, None, 1))
    rows.append((None, "a text without an id " + PASSAGE, None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def passage():
    return PASSAGE
