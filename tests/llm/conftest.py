import pytest
from pyspark.sql import types as T

#: Names that operators use inside; given as extra columns, they must not clash.
CLASHING = ("score", "keep", "pii", "id", "_id", "_hash", "print", "words", "label", "start", "length", "count", "items", "found", "base", "spans", "range")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows, and columns of clashing names."""
    long = "Erther ontion the leanst hering. " * 6000
    texts = [(1, "The quick brown fox jumps over the lazy dog again and again."), (1, "The quick brown fox jumps over the lazy dog again and again."), (2, ""), (3, None), (None, "No id here, but a text of some words."), (None, None), (4, long), (5, "The quick brown fox jumps over the lazy dog again and again."), (6, " \n\t "), (2, "Another text under a used id."), (7, "é" * 50 + " 😀 mail a.b@example.com")]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(x, T.StringType()) for x in CLASHING)])
    return spark.createDataFrame([(*x, *["?"] * len(CLASHING)) for x in texts], schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
