import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import distsim as ds  # noqa: E402


def make_session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("distsim-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Test files are small: cut them finer, so that several tasks read them.
        .config("spark.sql.files.minPartitionNum", "8")
        .config("spark.sql.files.openCostInBytes", "64k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ds.configure(spark)
    return spark


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    session.stop()


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")
