import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho".split()) + rng.choice(["", "s", "x", "ly"]) for _ in range(n))


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls anywhere, blanks, a very long text, one long run of letters and of digits, repeated rows, ids and texts."""
    rng = random.Random(3)
    rows = [
        (1, None, "en", "src1", 0), (2, "", None, None, None), (3, " \t\n", "en", "src1", 3), (None, "no id here at all", "en", None, 1),
        (None, None, None, None, None), (4, words(rng, 30_000), "en", "src0", 1), (5, "x" * 60_000, "de", "src0", 1),
        (6, "1" * 60_000 + " " + "1.2" * 3_000, "de", "src0", 1), (7, "repeated row of some words", "en", "src2", 1), (7, "repeated row of some words", "en", "src2", 1),
        (8, "repeated row of some words", "en", "src2", 1), (9, "same id one", "en", "src3", 1), (9, "same id two", "en", "src3", 1),
        (10, "naïve ünïcode 你好 😀 words", "fr", "", 1), (-5, "negative id", "fr", "other source", 1),
    ]
    # columns whose names the operators use themselves
    clash = ["text_key", "sid", "n", "label", "cell", "score", "kept", "h", "shard", "spans", "items", "x", "_row", "key", "group"]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts):
        return spark.createDataFrame([(i, t, "en", f"src{i % 4}", 0) for i, t in enumerate(texts)], SCHEMA)

    return make
