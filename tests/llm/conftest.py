import pytest

LONG = "lorem ipsum dolor " * 12_000


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with clashing names."""
    rows = [
        (1, "The quick brown fox jumps over it.", "en", "a", 34),
        (1, "The quick brown fox jumps over it.", "en", "a", 34),
        (2, "", "en", None, 0),
        (3, None, None, None, None),
        (None, "Só não é fácil, 日本語 too 😀", "pt", "b", 5),
        (None, None, None, None, None),
        (4, " \n\t ", "en", "a", 4),
        (5, "12345 67", "en", "a", 8),
        (6, LONG, "en", "a", len(LONG)),
        (7, LONG, None, "a", len(LONG)),
    ]
    named = [(*r, "x", 0, b"y", 1.0, "k", 3) for r in rows]
    schema = (
        "doc_id bigint, text string, lang string, source string, n_chars bigint, "
        "_text string, fp int, of binary, n_words double, kind string, _id int"
    )
    return spark.createDataFrame(named, schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
