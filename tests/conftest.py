import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    got = (
        SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    got.sparkContext.setLogLevel("ERROR")
    return got
