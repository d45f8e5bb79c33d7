import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["small", "large"])
def plan(request, spark):
    """Run a test with the plans for small and for large inputs (tiny blocks, nothing counts as small)."""
    if request.param == "large":
        spark.conf.set("lumora.smallRows", "0")
        spark.conf.set("lumora.blockRows", "7")
    yield request.param
    spark.conf.unset("lumora.smallRows")
    spark.conf.unset("lumora.blockRows")


@pytest.fixture
def large(spark):
    spark.conf.set("lumora.smallRows", "0")
    spark.conf.set("lumora.blockRows", "50")
    yield
    spark.conf.unset("lumora.smallRows")
    spark.conf.unset("lumora.blockRows")
