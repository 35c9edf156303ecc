import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(6_000))
    rows = [
        (1, None, "en", "src0", 0),
        (2, "", None, "src0", 0),
        (3, " \t\n", "en", None, None),
        (4, "one two three", "en", "src1", 13),
        (5, "one  two three", "en", "src1", 14),
        (5, "one  two three", "en", "src1", 14),
        (6, "one two  three", "en", "src9", 14),
        (None, "onetwothree", None, None, None),
        (None, "a text without an id", None, None, None),
        (7, long, "en", "src0", len(long)),
        (8, long + " end", "en", "src0", len(long) + 4),
        (9, "x" * 200_000, "en", "src2", 200_000),
        (10, "9" * 100_000, "en", "src2", 100_000),
        (11, "\U0001f600 é ́a <|endoftext|>  b", "fr", "src3", 20),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("of", "number", "winner", "digest", "repeat", "toxicity", "row", "node", "listed", "gone", "label"):
        docs = docs.selectExpr("*", f"doc_id as {name}")
    return docs


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
