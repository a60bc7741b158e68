import pytest

from stowage.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared")), "spark.driver.memory": "4g"})
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
