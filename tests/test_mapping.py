"""How order lines become statements: without sorting them, also for repeated and null keys."""

import datetime

import pytest

from revolva.sources import mapping


@pytest.fixture
def plain_plans(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def orders_dir(spark, tmp_path):
    day = datetime.datetime(1995, 1, 9)
    lines = [(1, 100.0, "N", 0.05), (1, 50.0, "R", 0.07), (None, 70.0, "N", 0.0), (2, 10.0, "N", 0.0), (3, 30.0, "N", 0.0), (9, 5.0, "N", 0.0)]
    spark.createDataFrame(
        [(key, day, price, flag, off, 0.02) for key, price, flag, off in lines],
        "l_orderkey long, l_shipdate timestamp, l_extendedprice double, l_returnflag string, l_discount double, l_tax double",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(
        [(1, 7), (2, 5), (2, 5), (None, 8), (3, None), (4, 7)], "o_orderkey long, o_custkey long"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_order_lines_are_joined_without_a_sort(spark, plain_plans, orders_dir):
    text = plain_plans(mapping.activity(spark, orders_dir))
    assert "ShuffledHashJoin [l_orderkey" in text and "SortMergeJoin" not in text and "Sort [" not in text


def test_months_are_joined_to_their_card_without_a_sort(spark, plain_plans, orders_dir):
    people = spark.createDataFrame([(7, 2000, 13)], "card_id long, credit_limit int, punctual int")
    text = plain_plans(mapping.statements(people, mapping.activity(spark, orders_dir)))
    assert "ShuffledHashJoin [card_id" in text and "SortMergeJoin" not in text


def test_repeated_and_null_keys(spark, orders_dir):
    got = {(r.card_id, r.idx, r.gross, r.net, r.discount, r.tax) for r in mapping.activity(spark, orders_dir).collect()}
    assert got == {(7, 0, 150, 100, 7, 2), (5, 0, 20, 20, 0, 2), (None, 0, 30, 30, 0, 2)}
