import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Makes documents from texts, with the columns of the table of that name and one more."""

    def make(texts, ids=None):
        rows = [(i, t, "en", "src", None if t is None else len(t), "x") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `class_id` string")

    return make


@pytest.fixture(scope="session")
def words():
    import random

    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(4000)]
    return lambda n, seed: [random.Random(seed * 1_000_003 + i).choice(vocabulary) for i in range(n)]
