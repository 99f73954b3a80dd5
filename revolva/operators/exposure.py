"""Exposure at default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revolva.config import DEFAULTS, RiskConfig
from revolva.functions.bands import exposure_at_default, utilization
from revolva.functions.numeric import exact_mean, exact_sum, fixed, fixed_sum, percent, ratio, rows, total
from revolva.plans.portfolio import Portfolio

# The scenarios of the sensitivity report.
CCF_SCENARIOS = (
    (0.00, "CCF = 0%  (Balance Only)"),
    (0.25, "CCF = 25%"),
    (0.50, "CCF = 50%"),
    (0.75, "CCF = 75% (Basel III)"),
    (1.00, "CCF = 100% (Full Limit)"),
)


def _unused() -> Column:
    return F.col("credit_limit") - F.col("statement_balance")


def _with_drawn_part(ccf: float) -> Column:
    """Balance plus the expected draw, the draw rounded to whole units."""
    return F.col("statement_balance").cast("double") + fixed(F.lit(ccf) * _unused(), 0)


def _ead(cfg: RiskConfig) -> Column:
    return exposure_at_default(cfg.ccf)


def _whole_ead(cfg: RiskConfig) -> Column:
    """Sum of exposures, each rounded to whole units first."""
    return exact_sum(fixed(_ead(cfg), 0)).cast("double")


def account_ead(p: Portfolio, cfg: RiskConfig = DEFAULTS, ordered: bool = False) -> DataFrame:
    """Exposure of every card of the last month; ``ordered`` sorts all of them, the largest first."""
    found = (
        p.latest_statements()
        .join(p.cards.select("card_id", "customer_id", "product_type"), "card_id")
        .select(
            "card_id",
            "customer_id",
            "product_type",
            "credit_limit",
            F.col("statement_balance").alias("current_balance"),
            _unused().alias("unused_limit"),
            fixed(utilization(), 4).alias("current_utilization"),
            _with_drawn_part(cfg.ccf).alias("ead_ccf_75"),
            F.col("credit_limit").alias("ead_ccf_100"),
            _with_drawn_part(0.50).alias("ead_ccf_50"),
        )
    )
    return found.orderBy(F.desc_nulls_last("ead_ccf_75"), "card_id") if ordered else found


def portfolio_ead(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return p.latest_statements().agg(
        rows().alias("total_accounts"),
        total("statement_balance").alias("total_current_balance"),
        total(_unused()).alias("total_unused_limit"),
        fixed_sum(_ead(cfg), 2).alias("portfolio_ead_75"),
        total("credit_limit").alias("portfolio_ead_100"),
        fixed(ratio(exact_sum(_ead(cfg)), total("statement_balance")), 4).alias("ead_uplift_factor"),
    )


def ead_by_product(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return (
        p.latest_statements()
        .join(p.cards.select("card_id", "product_type"), "card_id")
        .groupBy("product_type")
        .agg(
            rows().alias("accounts"),
            fixed(F.avg("credit_limit"), 0).alias("avg_credit_limit"),
            fixed(F.avg("statement_balance"), 0).alias("avg_current_balance"),
            fixed(F.avg(utilization()), 4).alias("avg_utilization"),
            fixed(exact_mean(_ead(cfg)), 0).alias("avg_ead"),
            _whole_ead(cfg).alias("total_ead"),
        )
        .orderBy(F.desc("total_ead"), "product_type")
    )


def ead_by_income(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return (
        p.latest_statements()
        .join(p.accounts, "card_id")
        .groupBy("income_band")
        .agg(
            rows().alias("accounts"),
            fixed(F.avg("card_limit"), 0).alias("avg_limit"),
            fixed(exact_mean(_ead(cfg)), 0).alias("avg_ead"),
            _whole_ead(cfg).alias("total_ead"),
            total(_unused()).alias("total_unused_limit"),
            percent(total(_unused()), total("credit_limit")).alias("unused_limit_pct"),
        )
        .orderBy(F.desc("total_ead"), "income_band")
    )


def ead_by_region(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return (
        p.latest_statements()
        .join(p.accounts, "card_id")
        .groupBy("region")
        .agg(
            rows().alias("accounts"),
            total("statement_balance").alias("current_exposure"),
            _whole_ead(cfg).alias("total_ead"),
            total("credit_limit").alias("max_possible_ead"),
            percent(_whole_ead(cfg), total("credit_limit")).alias("ead_as_pct_of_max"),
        )
        .orderBy(F.desc("total_ead"), "region")
    )


def ccf_sensitivity(p: Portfolio) -> DataFrame:
    """Portfolio exposure under each scenario, from one pass over the last month.

    Exposure is linear in the factor, so two sums serve all scenarios.
    """
    sums = p.latest_statements().agg(
        total("statement_balance").alias("balance"), total(_unused()).alias("unused")
    )
    scenarios = F.array(
        *[F.struct(F.lit(label).alias("ccf_scenario"), F.lit(ccf).alias("ccf_assumption")) for ccf, label in CCF_SCENARIOS]
    )
    exposure = F.col("balance").cast("double") + F.col("ccf_assumption") * F.col("unused")
    return (
        sums.select("balance", "unused", F.inline(scenarios))
        .select("ccf_scenario", fixed(exposure, 2).alias("portfolio_ead"), "ccf_assumption")
        .orderBy("ccf_assumption")
    )


def monthly_ead(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return (
        p.statements.groupBy("period_month")
        .agg(
            total("statement_balance").alias("current_balance"),
            total("credit_limit").alias("total_credit_limit"),
            fixed_sum(_ead(cfg), 2).alias("ead_75_ccf"),
            percent(exact_sum(_ead(cfg)), total("credit_limit")).alias("ead_utilization_pct"),
        )
        .orderBy("period_month")
    )
