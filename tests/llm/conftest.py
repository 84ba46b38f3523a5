import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and long texts, ties and repeated rows, and
    extra columns with clashing names."""
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog.\nSecond line here.", "en", "a", 0),
        (1, "The quick brown fox jumps over the lazy dog.\nSecond line here.", "en", "a", 0),
        (2, None, None, None, None),
        (None, "a text without an id", "en", "b", 5),
        (None, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, long, "en", "a", 1),
        (5, long + " end", "en", "a", 1),
        (6, "  \t \n\n ", "en", "a", 1),
        (7, "one", "en", "a", 1),
        (8, "The  quick brown fox jumps over the lazy dog. \nSecond line here.", "en", "a", 1),
        (1, "another text of the same id", "en", "a", 1),
    ]
    return spark.createDataFrame(rows, DOCS).selectExpr(
        "*", "1 AS shard", "'x' AS slot", "2 AS part", "'y' AS `row`", "0 AS score", "array(1) AS gone", "'k' AS dedup", "7 AS toxicity", "n_chars AS `dotted.name`"
    )


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
