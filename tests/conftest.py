import pytest

from evlog.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="8", partitions=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def raw_table(spark):
    def make(lines, batch="b"):
        rows = [(batch, i, line) for i, line in enumerate(lines)]
        return spark.createDataFrame(rows, "batch_id string, pos bigint, raw string")

    return make
