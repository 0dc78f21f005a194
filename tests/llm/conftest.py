import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, vocabulary=400):
    """Words of letters only: digits would make them variable fields."""
    return " ".join("w" + str(rng.randrange(vocabulary)).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, wordless, very long and repeated texts, repeated ids, no id, wide characters."""
    rng = random.Random(3)
    long = words(rng, 40_000)
    near = words(rng, 120, 4000)
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n \v\f\r\n", "en", "a", 8),
        (4, long, "en", "b", len(long)),
        (5, near, "en", "b", len(near)),
        (6, near.replace("w", "W"), "en", None, len(near)),
        (7, near + " tail", None, "b", len(near) + 5),
        (8, "one two", "en", "b", 7),
        (8, "one two", "en", "b", 7),
        (8, "another text under the same id", "en", "b", 30),
        (None, "no id at all here", "en", "c", 17),
        (None, None, None, None, None),
        (9, "日本語 テキスト é\u00a0ñ 🙂 <|endoftext|>", "ja", "é", 30),
        (-5, "one two", "en", "z", 7),
        (10, "a b c d e f g", "en", "b", 13),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def duck(folder="/root/testdata/sf0.001"):
    """A DuckDB connection whose view is the table."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    return con


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
