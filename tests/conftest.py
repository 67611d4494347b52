import pytest

from tessera.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("4", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
