import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keys string, row string, component string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text) rows with further columns whose names clash with the operators' own."""

    def build(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", "r", "c") for i, t in rows], SCHEMA).repartition(3)

    return build


@pytest.fixture(scope="session")
def prose():
    """Seeded text of n words."""

    def write(seed, n, vocabulary=400):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(vocabulary)}{'.' if rng.random() < 0.1 else ''}" for _ in range(n))

    return write


#: Texts that every operator must take: null, empty, blank, one word, white space of all kinds, a very long one, repeats.
def awkward(prose):
    return [(1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, "one"), (5, "Zwei  Wörter…\n\n"), (6, prose(6, 30_000)), (7, prose(7, 80)), (7, prose(7, 80)), (8, prose(7, 80)), (9, "x" * 5000), (10, "a b c d e f g h i j " * 30)]
