import os

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(FOLDER):
        pytest.skip("tables not present")
    return FOLDER


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names clash with internal ones."""
    prose = " ".join(f"word{i % 97} and then{i}" for i in range(150))
    long = " ".join(f"w{(i * i) % 1013}" for i in range(60_000))
    rows = [(1, prose, "en", "a", 10), (2, prose, "en", "a", 10), (2, prose, "en", "a", 10), (3, None, None, None, None),
            (4, "", "en", "b", 0), (None, "no id here but words", "en", "b", 20), (5, long, "en", None, 1), (6, "   \n\t ", None, "a", 6),
            (7, prose + " changed", "en", "a", 10), (8, "!!! 123 ###", "fr", "c", 11), (9, "Été à la plage", "fr", "c", 14),
            (None, None, None, None, None), (10, "été a b \x1c c <|endoftext|> d'accord", "fr", "c", 9), (10, "same id, other text", "en", "d", 3)]
    extra = [(*r, i, "x", 0, 0) for i, r in enumerate(rows)]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, shard int, id string, size int, n int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
