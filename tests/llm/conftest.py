import pytest

EDGES = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \n\t ", "en", None),
    (5, "word", None, "b"),
    (6, "x" * 30_000, "en", "b"),
    (7, "long text here " * 4_000, "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (None, "no identifier at all, a@b.example.com", "en", "c"),
    (9, "mail me: jo@mail.example.com or +1 (212) 555-0100, card 4111 1111 1111 1111, host 10.1.2.3", "en", "a"),
    (10, "ünïcödé — 日本語 😀 text wide", "ja", "b"),
    (-11, "The quick brown fox jumps over the lazy dog near the river bank today!", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like those that operators make."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGES, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    for name in ("ids", "row", "digest", "node", "kept_id", "text_hash", "slot", "block", "spans", "added", "d", "t", "h", "_s", "words", "lines", "prefix", "key"):
        df = df.withColumn(name, F.lit(7))
    return df


@pytest.fixture(scope="session")
def empty(edges):
    return edges.limit(0)
