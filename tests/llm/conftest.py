import random

import pytest

WORDS = "the quick brown fox jumps over a lazy dog while seven old wizards mix potions near silent rivers of glass and iron".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, names that operators use inside."""
    base = prose(1, 120)
    rows = [
        (1, base, "en", "s", 1),
        (1, base, "en", "s", 1),
        (2, base, "en", None, None),
        (3, None, "en", "s", 0),
        (4, "", None, "s", 0),
        (5, "   \n\n ", "en", "s", 0),
        (None, prose(2, 60), "en", "s", 0),
        (None, None, None, None, None),
        (6, base + " tail", "en", "s", 0),
        (7, "one two three", "en", "s", 0),
        (8, "ONE two\tthree", "en", "s", 0),
        (9, "x" * 9000 + " " + prose(3, 3000) + "\nnaïve 漢字 🙂 \x00 end", "en", "s", 0),
        (10, "\n".join([prose(4, 12)] * 3 + [prose(5, 12)]), "en", "s", 0),
        (11, "…漢字漢字漢字漢字漢字", "zh", "s", 0),
    ]
    names = ["sk", "k", "row", "o", "key", "length", "score", "_text", "start", "spans", "n_words", "dropped", "rep", "root", "h", "n"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(*r, *(["z"] * len(names))) for r in rows], schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
