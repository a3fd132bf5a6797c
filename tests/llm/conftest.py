import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """The table as a list of rows."""
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns whose names clash with inner ones."""
    long = "Größe und Maß. the cat's 12 mats\n" * 4000
    rows = [(1, "a b c d e", "en", "x", 9, 0, "k"), (1, "a b c d e", "en", "x", 9, 0, "k"), (2, None, None, None, None, None, None), (3, "", "en", "x", 0, 1, ""), (4, " \t\n ", "de", None, 4, 1, "k"),
            (None, "a b c d e", "en", "y", 9, 1, "k"), (None, None, "en", "y", 9, 1, "k"), (5, long, "de", "y", len(long), 1, "k"), (6, long + "x", "de", "y", len(long), 1, "k"),
            (7, "x y▁z ▁ q\u0000r \U0001f600 <|endoftext|> don't", "en", "x", 5, 0, "k"), (7, "other text of the same id", "en", "x", 5, 0, "k"), (8, "one", "en", "z", 3, 0, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, first string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
