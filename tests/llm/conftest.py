import pytest

#: Null and empty texts, ties, repeated rows, a null id, a null source, one very long text; extra columns with names that operators use themselves.
LONG = " ".join(f"word{i % 7919}" for i in range(120_000))
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly box with liquid jugs near old town"
ROWS = [
    (1, PROSE, "en", "b", 1),
    (2, PROSE, "en", "b", 1),
    (2, PROSE, "en", "b", 1),
    (3, None, "en", "a", None),
    (4, "", None, "a", 0),
    (5, " \t\n ", "en", None, 4),
    (6, "one two", "en", "b", 7),
    (7, LONG, "en", "a", len(LONG)),
    (None, "a row without an id", "en", "c", 19),
    (8, PROSE + " and so on", "en", "c", 1),
    (9, "mail me@example.org now\nmail me@example.org now\nmail me@example.org now", "fr", "c", 70),
    (10, "naïve ÉCOLE — 東京 ☕", "fr", "\U0001f600", 20),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["score", "shard", "id", "cell", "component", "size", "rank", "label"]


@pytest.fixture(scope="session")
def edge(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in CLASHING:
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
