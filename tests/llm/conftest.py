import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def doc_rows(texts, langs=None):
    return [(i, t, (langs or {}).get(i), f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, langs=None):
        return spark.createDataFrame(doc_rows(texts, langs), SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and columns named like outputs."""
    long_text = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", "a", 3),
        (5, long_text, "en", "b", len(long_text)), (6, long_text, None, "b", len(long_text)),
        (7, "7 8 9 !!", "de", "b", 8), (8, "Ünïcode 日本語 🙂 text", "de", None, 20),
        (8, "Ünïcode 日本語 🙂 text", "de", None, 20), (None, "a text without an id", "en", "c", 20),
        (None, None, None, None, None),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    names = ("rest", "kept", "u", "v", "leaf", "slice", "guest", "score", "row_key", "ids", "n", "word", "part",
             "component_id", "n_words", "kept_text", "shard", "slot", "secret", "probability", "passage", "band")
    return docs.withColumns({name: F.lit("x") for name in names})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
