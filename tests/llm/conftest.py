import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that operators use for computed columns.
CLASHES = ("size", "kept", "score", "n", "_id", "fp", "node", "text_sha256", "target", "_text")


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """(doc_id, text) or (doc_id, text, source) rows as documents with clashing extra columns."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.select("*", *[F.lit(7).alias(c) for c in CLASHES])

    return make


@pytest.fixture(scope="session")
def awkward(make_docs):
    """Null ids and texts, empty and blank texts, a very long one, ties and repeated rows."""
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(30_000))
    return make_docs([(1, "Alpha beta gamma delta epsilon zeta"), (2, "alpha BETA gamma delta epsilon zeta"), (2, "alpha BETA gamma delta epsilon zeta"), (3, None), (4, ""), (5, " \t\n"), (None, "alpha beta"), (None, None), (6, long, None), (7, long, "other"), (8, "one"), (9, "é ß 漢字 😀 \x1c x", None), (10, "a" * 5000)])
