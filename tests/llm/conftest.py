"""Small tables with nulls, empty and long texts, repeated rows and clashing columns."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta,", "Gamma.", "ünder", "naïve", "x1"]) for _ in range(30000))
    rows = [(1, "", "en", "a", 0), (2, None, None, None, None), (3, long, "en", "a", len(long)), (4, "one two", "en", "a", 7),
            (4, "one two", "en", "a", 7), (None, "no id here", "en", "b", 10), (6, " \n\t ", None, "b", 4), (5, "日本語   <|endoftext|> x", "ja", "b", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def wide(spark):
    """Adds columns whose names operators use inside."""
    def add(df, names="words length piece start rank key bucket idx n part file at first component fingerprint seq sim label id".split()):
        from pyspark.sql import functions as F
        return df.select("*", *(F.lit(7).alias(n) for n in names if n not in df.columns))
    return add
