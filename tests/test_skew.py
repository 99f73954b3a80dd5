"""A third of all orders belong to one customer, a third of all lines to one order."""

import compare
import pytest
from pyspark.sql import functions as F

import oracle
from revolva import registry
from revolva.sources import mapping, store


@pytest.fixture(scope="module")
def skewed_dir(spark, small_dir, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("skewed"))
    for t in compare.TABLES:
        df = spark.read.parquet(f"{small_dir}/{t}.parquet")
        if t == "orders":
            df = df.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(F.col("o_custkey")))
        if t == "lineitem":
            df = df.withColumn("l_orderkey", F.when(F.col("l_linenumber") % 3 == 0, 1).otherwise(F.col("l_orderkey")))
        df.coalesce(1).write.parquet(f"{out}/{t}.parquet")
    return out


def test_a_card_never_has_more_rows_than_months(spark, skewed_dir):
    p = store.load(spark, skewed_dir)
    assert p.statements.groupBy("card_id").count().agg(F.max("count")).first()[0] <= mapping.MONTHS


NAMES = ["roll_matrix", "kpi_region", "rfm_scoring", "vintage_cumulative", "expected_loss_account", "export_segments"]


@pytest.mark.parametrize("name", NAMES)
def test_results_stay_exact(spark, skewed_dir, name):
    con = compare.connect(skewed_dir, files="*.parquet")
    assert compare.difference(registry.build()[name](spark, skewed_dir), con, oracle.build()[name]) is None
