import pytest

from glossa.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def run(spark):
    """Result of a registered query on sf0.01 as a pandas frame (computed once)."""
    done = {}

    def get(name):
        if name not in done:
            done[name] = queries.QUERIES[name](spark, SF).toPandas()
        return done[name]

    return get


@pytest.fixture(scope="session")
def given(spark):
    done = {}

    def get(name):
        if name not in done:
            done[name] = spark.read.parquet(f"{SF}/{name}.parquet").toPandas()
        return done[name]

    return get
