import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

DATA = os.environ.get("TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("revolva-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_dir():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def medium_dir():
    return f"{DATA}/sf0.01"


@pytest.fixture(scope="session")
def make(spark):
    """Build a portfolio from hand-written rows; dimensions default to one card each."""
    from revolva.plans.portfolio import Portfolio
    from revolva.sources import schemas

    def build(statements, cards=None, customers=None, writeoffs=()):
        ids = sorted({s[0] for s in statements if s[0] is not None})
        cards = cards if cards is not None else [(i, i, "classic", 2000) for i in ids]
        customers = customers if customers is not None else [(i, "ASIA", "low", 30, 5) for i in ids]
        return Portfolio(
            spark.createDataFrame(customers, schemas.CUSTOMERS),
            spark.createDataFrame(cards, schemas.CARDS),
            spark.createDataFrame(list(statements), schemas.STATEMENTS),
            spark.createDataFrame(list(writeoffs), schemas.WRITEOFFS),
        )

    return build
