import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (id, text) pairs, written and read back."""
    import tempfile

    def make(rows, extra=False):
        full = [(i, t, "en", f"src{k % 4}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for c in ("id", "key", "score", "blob", "_row", "side", "rank", "v"):
                df = df.withColumn(c, F.lit("x"))
        path = tempfile.mkdtemp() + "/t.parquet"
        df.write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, empty and very long texts, repeated rows, ties, clashing columns."""
    long = "alpha beta gamma delta " * 30000
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, long), (6, "x" * 50000), (7, "same text here for all of us"), (8, "same text here for all of us"),
            (8, "same text here for all of us"), (None, "no id at all"), (9, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'), (10, "Éa ça 漢字 😀 <|endoftext|> it's")]
    return docs_of(rows, extra=True)
