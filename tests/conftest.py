import os

import pytest
from pyspark.sql import SparkSession

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[4]").appName("tests")
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.driver.host": "127.0.0.1",
    }
    for k, v in conf.items():
        builder = builder.config(k, v)
    os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(__file__)))
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
