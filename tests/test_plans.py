"""Shapes of the physical plans."""

import re

import pytest

from revolva import registry


@pytest.fixture
def plan(spark, small_dir):
    """The plan as it would be with dimensions too large to broadcast."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield lambda name: registry.build()[name](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    for k, v in before.items():
        spark.conf.set(k, v)


PER_CARD = [
    "credit_utilization",
    "customer_risk_profile",
    "roll_rate_base",
    "vintage_base",
    "early_warning",
    "rolling_util_3m",
    "card_features",
    "master_features",
    "delinquency_streaks",
    "first_payment_default",
]


@pytest.mark.parametrize("name", PER_CARD)
def test_per_card_work_needs_no_shuffle(plan, name):
    assert "Exchange hashpartitioning" not in plan(name)
    assert "Exchange rangepartitioning" not in plan(name)


SINGLE_SCAN = ["roll_rate_base", "collections_efficiency", "vintage_cumulative", "cohort_retention", "net_roll"]


@pytest.mark.parametrize("name", SINGLE_SCAN)
def test_no_self_join(plan, name):
    text = plan(name)
    assert text.count("FileScan") == 1 and "Join" not in text


@pytest.mark.parametrize("name", ["kpi_region", "pd_income", "roll_region", "export_segments", "payment_gap"])
def test_segments_shuffle_aggregates_only(plan, name):
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(name))
    assert keys and not any("card_id" in k or "customer_id" in k for k in keys)


def test_sensitivity_reads_the_last_month_once(plan):
    assert plan("ead_ccf_sensitivity").count("FileScan") == 1  # the store knows the date of the last month


def test_columns_are_pruned(plan):
    schema = re.findall(r"ReadSchema: struct<([^>]*)>", plan("kpi_monthly_trend"))
    assert schema == ["period_month:date,statement_balance:int,days_past_due:int"]


def test_no_python_in_any_plan(plan):
    for name in sorted(set(registry.ON_CLEAN) | set(registry.ON_DIRTY)):
        text = plan(name)
        assert not re.search(r"ArrowEval|BatchEvalPython|InPandas|InArrow|CartesianProduct", text), name


@pytest.mark.parametrize("name", ["rfm_scoring", "risk_decile", "default_model_split"])
def test_cuts_move_keys_only(plan, name):
    """Cuts are found by counting: no order over all rows, and no job before the result is asked for."""
    text = plan(name)
    assert "rangepartitioning" not in text and "Scan ExistingRDD" not in text
    moved = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert moved and all(re.match(r"(key|grp|_w?grp)#", k) for k in moved)


def test_cuts_are_found_when_the_result_is_asked_for(spark, small_dir):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    registry.build()["risk_decile"](spark, small_dir)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) == len(before)
