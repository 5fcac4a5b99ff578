import pytest
from llm_rows import CLASHES, DOCUMENT, edge_rows


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), DOCUMENT).cache()


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="session")
def clashing(spark, edges):
    from pyspark.sql import functions as F

    return edges.withColumns({c: F.lit("theirs") for c in CLASHES})


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def tokenizers_at():
    import public_tokenizers

    return public_tokenizers.path
