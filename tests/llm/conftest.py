import pytest

PROSE = "the quick brown fox jumps over one lazy dog while seven other foxes watch from far across a cold wide river bank"


def words(seed: int, n: int) -> str:
    """Made words that differ between seeds."""
    return " ".join(f"w{(seed * 7919 + i * 104729) % 50021}x{seed}" for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns with clashing names."""
    long = words(3, 60_000)
    rows = [
        (1, PROSE, "en", "a", 5, "x"), (2, PROSE, "en", "a", 5, "x"), (2, PROSE, "en", "a", 5, "x"), (3, None, None, None, None, None), (4, "", "en", "b", 0, "x"),
        (5, " \t\n", "en", "b", 3, "x"), (6, long, "de", "b", len(long), "x"), (None, "a null key", "en", "a", 1, "x"), (7, "two words", "en", "a", 1, "x"),
        (8, "Zwei Wörter 😀 é", "de", "a", 1, "x"), (9, words(1, 300), "en", "a", 1, "x"), (10, words(1, 299) + " changed", "en", "a", 1, "x"), (11, words(2, 300), None, "c", 1, "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    return df.selectExpr("*", "n_chars AS n_words", "kept AS shard", "kept AS node", "kept AS secrets", "kept AS code", "kept AS _start")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()
