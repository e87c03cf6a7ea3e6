import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty, blank and long texts, ties, repeated rows and columns with clashing names."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n ", "en", "a", 4),
        (4, prose(1, 60), "en", "a", 1),
        (5, prose(1, 60), "en", "b", 1),
        (5, prose(1, 60), "en", "b", 1),
        (6, prose(2, 6000), "de", "a", 1),
        (7, "one two", None, None, 7),
        (None, prose(3, 80), "en", None, 1),
        (8, "Ünïcödé   \x85 text \U0001f600 <|endoftext|> # * $ | done", "fr", "é", 1),
        (9, prose(4, 100).upper(), "en", "a", 1),
        (10, "x" * 300_000, "en", "z", 1),
        (11, "12 34 5.6 --", "en", "z", 1),
    ]
    d = spark.createDataFrame(rows, SCHEMA)
    extra = {"size": "c1", "u": "c2", "node": "c3", "q_kept": "c4", "copies": "c5", "row": "c6", "score": "c7", "h": "c8", "place": "c9", "_id": "c10"}
    from pyspark.sql import functions as F

    return d.withColumns({k: F.lit(v) for k, v in extra.items()})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
