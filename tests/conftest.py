import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("faultledger-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def facts(spark, sf_dir):
    from faultledger.testbed import star_extracts

    return star_extracts.store(spark, sf_dir).incidents()


@pytest.fixture
def incidents(spark):
    """Make cleaned incidents from short tuples."""
    from datetime import date
    from decimal import Decimal

    from faultledger.schemas import UNIFIED

    def make(*rows, run_id="run-1", file="f1"):
        full = [
            (s, p, c, date.fromisoformat(d) if d else None, k, Decimal(str(a)), float(q), file, run_id)
            for s, p, c, d, k, a, q in rows
        ]
        return spark.createDataFrame(full, UNIFIED)

    return make
