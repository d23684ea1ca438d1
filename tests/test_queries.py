import pytest
from oracle import same

from tensorfold.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, data, name):
    assert same(spark, data, QUERIES[name], SQL[name]) > 0 or name == "q_unique_names"


@pytest.mark.parametrize(("name", "source", "times"), [("q_slice_negative", "embeddings", 1), ("q_broadcast", "embeddings", 4), ("q_cast_narrow", "lineitem", 1), ("q_reshape", "embeddings", 64)])
def test_whole_tables(spark, data, name, source, times):
    assert QUERIES[name](spark, data).count() == times * spark.read.parquet(f"{data}/{source}.parquet").count()


def test_every_vector_is_pushed(spark, data):
    assert sum(r["ntensors"] for r in QUERIES["q_push"](spark, data).collect()) == spark.read.parquet(f"{data}/embeddings.parquet").count()
