"""Small tables with the awkward rows that every operator has to take."""

import pytest
from pyspark.sql import functions as F

TEXT_ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today"), (2, None), (3, ""), (4, "   \t\n "), (5, "one"),
    (6, "The quick brown fox jumps over the lazy dog near the river bank today"), (7, "Grüße 東京 😀 naïve café x  y   z"),
    (8, "a " * 3000), (9, "x" * 5000), (None, "a row without a key"), (5, "one"), (10, "▁ odd ▁▁ marks <|endoftext|> <s>"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, long and repeated rows, with extra columns named like those the operators make."""
    docs = spark.createDataFrame(TEXT_ROWS, "doc_id bigint, text string")
    return docs.select("*", *(F.lit(None).cast("string").alias(c) for c in (
        "id", "n_tokens", "component", "sketch", "word", "_bucket", "key", "part", "row", "score")))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
