"""Money is added up exactly: any partitioning and order gives the same digits."""

import random
from dataclasses import replace
from decimal import Decimal

import pytest
from panels import statement
from pyspark.sql import functions as F

from revolva.functions.numeric import exact_mean, exact_sum, fixed_sum
from revolva.operators import default_probability, expected_loss, exposure, loss_given_default
from revolva.sources import store


@pytest.fixture(scope="module")
def p(spark, small_dir):
    return store.load(spark, small_dir)


SUMMED = [
    exposure.portfolio_ead,
    exposure.monthly_ead,
    exposure.ead_by_region,
    expected_loss.summary,
    expected_loss.by_stage,
    expected_loss.by_product,
    expected_loss.monthly_reserve,
]


@pytest.mark.parametrize("operator", SUMMED)
def test_bit_equal_for_every_partitioning(p, operator):
    dealt = [replace(p, statements=p.statements.repartition(n, F.rand(n))) for n in (4, 7, 64)]
    first, *others = (sorted(map(repr, operator(x).collect())) for x in dealt)
    assert others == [first, first]


def test_twenty_million_terms(spark):
    amounts = lambda n: spark.range(0, 20_000_000, 1, n).select(
        (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1000.0 + 1e7 * (F.col("id") % 3)).alias("x")
    )
    sums = [amounts(n).agg(exact_sum("x").alias("s"), exact_mean("x").alias("m")).first() for n in (4, 7, 64)]
    assert sums[0] == sums[1] == sums[2]


def test_sums_beyond_a_quintillion(spark):
    df = spark.createDataFrame([(9e17,)] * 1000 + [(0.25,)], "x double")
    row = df.agg(exact_sum("x").alias("s"), fixed_sum("x", 1).alias("f")).first()
    assert row.s == Decimal(9 * 10**20) + Decimal("0.25") and row.f == 9e20


def test_terms_are_not_lost_beside_large_ones(spark):
    rng = random.Random(4)
    terms = [10.0**14, -(10.0**14), *[rng.randrange(10**6) / 100 for _ in range(500)]]
    rng.shuffle(terms)
    want = sum(Decimal(repr(x)) for x in terms)
    assert spark.createDataFrame([(x,) for x in terms], "x double").agg(exact_sum("x")).first()[0] == want
    assert spark.createDataFrame([], "x double").agg(exact_mean("x")).first()[0] is None


ORDERED = {
    default_probability.score_12m: "pd_score_12m",
    expected_loss.by_account: "expected_loss",
    exposure.account_ead: "ead_ccf_75",
    loss_given_default.lgd_account_detail: "lgd",
}


@pytest.mark.parametrize("operator", list(ORDERED))
def test_an_order_is_only_made_when_asked_for(p, operator):
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan(operator(p)).lower() and "\nSort" not in plan(operator(p))
    ordered = operator(p, ordered=True)
    assert "rangepartitioning" in plan(ordered).lower()
    values = [r[ORDERED[operator]] for r in ordered.collect()]
    assert values == sorted(values, key=lambda v: (v is None, -(v or 0)))
    assert ordered.exceptAll(operator(p)).count() == 0


def test_a_card_counts_once(make):
    p = make([statement(c, m) for c in range(4) for m in range(3)])
    assert exposure.portfolio_ead(p).first().total_accounts == 4
    assert {r.months_on_book for r in default_probability.score_12m(p).collect()} == {3}
