import pytest

#: Texts that every operator on documents must stand: nulls, empty, blank, copies, ties, odd characters, a very long one.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog near the bank", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the bank", "en", "a"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \t\n ", "fr", ""),
    (6, "été à la plage, c'est l'été — ça va? 日本語のテキスト 😀", "fr", "b"),
    (7, "123 456 !!! ###", "en", "b"),
    (8, "word " * 40_000, "en", "c"),
    (9, "x" * 30_000, None, "c"),
    (10, "Licensed under the MIT License. mit license MIT-LICENSE apache\nlicense; CC BY 4.0", "en", None),
    (10, "Licensed under the MIT License. mit license MIT-LICENSE apache\nlicense; CC BY 4.0", "en", None),
    (None, "a row without an id", "en", "d"),
    (12, "\x00\x01 control \x0b\x0c chars\r\n", "de", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with other columns whose names clash with those that operators make."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in ("score", "node", "slot", "h", "keep", "size", "part", "uid", "run", "key", "n_words", "shard", "row_no")})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def odd_rows():
    return ODD
