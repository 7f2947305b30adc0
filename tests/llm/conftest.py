import pytest
from pyspark.sql import types as T


@pytest.fixture
def docs(spark):
    """Documents from texts, with columns whose names clash with the operators' own."""

    def make(*texts, sources=None, langs=None, ids=None):
        ids = ids or range(len(texts))
        rows = [(i, t, (langs or ["en"] * len(texts))[k], (sources or ["a"] * len(texts))[k], len(t or ""), 7, "x") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.IntegerType()), T.StructField("key", T.StringType())])
        return spark.createDataFrame(rows, schema)

    return make
