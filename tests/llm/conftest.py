import pytest

COLUMNS = "doc_id long, text string, lang string, th string, doc long"


@pytest.fixture(scope="session")
def docs(spark):
    """A frame of (doc_id, text) with further columns named like internal ones."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, None, "x", 7) for i, t in rows], COLUMNS
        )

    return make


@pytest.fixture(scope="session")
def text_of():
    """Made-up words, the same for a seed."""
    import random

    def make(seed, n, vocabulary=5_000):
        r = random.Random(seed)
        return [f"w{r.randrange(vocabulary)}" for _ in range(n)]

    return make
