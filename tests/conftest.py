import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    session = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
               .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def skewed(spark):
    """Three series; one holds most rows, times repeat, values are seeded."""
    from pyspark.sql import functions as F
    n = 3000
    key = F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "mid").otherwise("cold")
    return spark.range(n).select(
        key.alias("symbol"), (F.floor(F.col("id") / 3) * 1_000_000).alias("ts"), F.col("id"),
        F.round(100 + 10 * F.sin(F.col("id") / 20) + F.rand(7) * 5, 2).alias("price"),
        F.floor(F.rand(11) * 20).cast("double").alias("qty"))
