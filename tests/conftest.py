import pytest

from ledgerloom.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    return spark
