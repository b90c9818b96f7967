import pytest


@pytest.fixture
def docs(spark):
    """Rows with NULLs, empty and long texts, ties, repeated rows and extra columns whose names operators use inside."""
    def make(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if extra:
            from pyspark.sql import functions as F
            df = df.withColumns({c: F.lit("x") for c in ("id", "row_key", "spans", "fp", "line", "bucket", "key")})
        return df
    return make


@pytest.fixture
def awkward():
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    line = "The same line stands here and there, often."
    return [(1, None), (2, ""), (3, " \t "), (4, "é日本 ▁▁ x"), (5, long), (6, line), (6, line), (7, f"{line}\n{line}\nA new last line of text."),
            (None, "A text without an id, twice over."), (None, "A text without an id, twice over."), (8, "a" * 5000), (9, "\n\n")]
