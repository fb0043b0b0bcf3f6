import pytest

#: Rows that every operator over documents must take: nulls, empty and blank texts, ties, repeats, a very long text, odd characters.
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


ROWS = [
    (1, prose(1, 60), "en", 9),
    (2, prose(1, 60), "en", 9),  # an exact copy
    (3, prose(1, 59) + " changed", "en", 9),  # a near copy
    (4, None, None, 9),
    (5, "", "en", 9),
    (6, " \n\t ", "fr", 9),
    (7, "One", "fr", 9),
    (8, "ONE", "de", 9),
    (9, prose(2, 30_000), "en", 9),  # very long
    (10, "x" * 70_000, "en", 9),  # one long word
    (11, "é ß 日本語 a  b \n \n c <|endoftext|> d​́", None, 9),
    (12, prose(3, 40), "en", 9),
    (12, prose(3, 40), "en", 9),  # a repeated row
    (13, prose(4, 25) + "\n" + prose(4, 25), "de", 9),
]


@pytest.fixture(scope="session")
def docs(spark):
    # columns named like results must not get in the way
    return spark.createDataFrame([(*r, "clash", 1.5) for r in ROWS], "doc_id long, text string, lang string, n_words long, row string, score double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
