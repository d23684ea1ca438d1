import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs."""

    def docs(pairs):
        return spark.createDataFrame([(i, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(pairs)], SCHEMA)

    return docs
