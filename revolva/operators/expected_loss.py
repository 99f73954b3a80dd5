"""Expected loss: default score times loss share times exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revolva.config import DEFAULTS, RiskConfig
from revolva.functions.bands import (
    dpd_at_least,
    exposure_at_default,
    lgd,
    logistic,
    payment_ratio,
    utilization,
)
from revolva.functions.numeric import exact_mean, exact_sum, fixed, fixed_sum, percent, ratio, rows
from revolva.operators.default_probability import risk_driver
from revolva.plans.portfolio import Portfolio


def portfolio_lgd(p: Portfolio) -> Column:
    """Mean loss share of all write-offs at four decimals, as a scalar subquery."""
    return p.writeoffs.select(fixed(F.avg(lgd()), 4).alias("lgd")).scalar()


def account_risk(p: Portfolio, *keys: str, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """Score, exposure and worst days past due per key.

    Exposure is that of the last month, NULL for a card without a statement
    then. The score uses unrounded features.
    """
    in_last_month = F.col("period_month") == p.latest_month()
    driver = risk_driver(
        F.avg(utilization()),
        F.avg("days_past_due"),
        F.count_if(dpd_at_least(cfg.delinquent_dpd)),
        F.avg(payment_ratio()),
        cfg,
    )
    return (
        p.statements.groupBy(*keys)
        .agg(
            F.avg("statement_balance").alias("avg_balance"),
            F.max(F.when(in_last_month, exposure_at_default(cfg.ccf))).alias("ead"),
            fixed(logistic(driver), 4).alias("pd_score"),
            F.max("days_past_due").alias("max_dpd"),
        )
        .withColumn("lgd", portfolio_lgd(p))
    )


def _loss() -> Column:
    return F.col("pd_score") * F.col("lgd") * F.col("ead")


def _stage(cfg: RiskConfig, third: str, second: str, first: str) -> Column:
    return (
        F.when(F.col("max_dpd") >= cfg.default_dpd, third)
        .when(F.col("pd_score") >= cfg.stage_2_score, second)
        .otherwise(first)
    )


def by_account(p: Portfolio, cfg: RiskConfig = DEFAULTS, ordered: bool = False) -> DataFrame:
    """Expected loss of every card; ``ordered`` sorts all of them, the largest first."""
    stage = _stage(
        cfg,
        "Stage 3 (Credit-Impaired)",
        "Stage 2 (Significant Increase in CR)",
        "Stage 1 (Performing)",
    )
    found = (
        account_risk(p, "card_id", "credit_limit", cfg=cfg)
        .join(p.accounts, "card_id")
        .select(
            "card_id",
            "customer_id",
            "product_type",
            "region",
            "income_band",
            "credit_limit",
            fixed("avg_balance", 0).alias("avg_balance"),
            fixed("ead", 0).alias("ead"),
            F.col("pd_score").alias("pd"),
            "lgd",
            fixed(_loss(), 2).alias("expected_loss"),
            fixed(F.col("pd_score") * F.col("lgd") * 100.0, 4).alias("el_rate_pct"),
            "max_dpd",
            stage.alias("ifrs9_stage"),
        )
    )
    return found.orderBy(F.desc_nulls_last("expected_loss"), "card_id") if ordered else found


def summary(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """One row. The first stage counts every low score, whatever the days past
    due, so it overlaps the third; ``by_stage`` counts each card once."""
    low, high = F.col("pd_score") < cfg.stage_2_score, F.col("pd_score") >= cfg.stage_2_score
    defaulted = F.col("max_dpd") >= cfg.default_dpd
    return (
        account_risk(p, "card_id", cfg=cfg)
        .groupBy("lgd")
        .agg(
            exact_sum("ead").cast("double").alias("total_ead"),
            fixed(exact_mean("pd_score"), 4).alias("avg_pd"),
            fixed_sum(_loss(), 2).alias("total_expected_loss"),
            percent(exact_sum(_loss()), exact_sum("ead"), 4).alias("el_rate_pct"),
            F.count_if(defaulted).alias("stage_3_accounts"),
            F.count_if(high & ~defaulted).alias("stage_2_accounts"),
            F.count_if(low).alias("stage_1_accounts"),
        )
        .select(
            "total_ead",
            F.col("lgd").alias("portfolio_lgd"),
            "avg_pd",
            "total_expected_loss",
            "el_rate_pct",
            "stage_3_accounts",
            "stage_2_accounts",
            "stage_1_accounts",
        )
    )


def by_stage(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return (
        account_risk(p, "card_id", cfg=cfg)
        .groupBy(_stage(cfg, "Stage 3", "Stage 2", "Stage 1").alias("ifrs9_stage"), "lgd")
        .agg(
            rows().alias("accounts"),
            fixed(exact_mean("pd_score"), 4).alias("avg_pd"),
            fixed_sum("ead", 0).alias("total_ead"),
            fixed_sum(_loss(), 2).alias("total_expected_loss"),
            percent(exact_sum(_loss()), exact_sum("ead"), 4).alias("el_rate_pct"),
        )
        .select(
            "ifrs9_stage", "accounts", "avg_pd", "lgd", "total_ead", "total_expected_loss", "el_rate_pct"
        )
        .orderBy("ifrs9_stage")
    )


def by_product(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return (
        account_risk(p, "card_id", cfg=cfg)
        .join(p.cards.select("card_id", "product_type"), "card_id")
        .groupBy("product_type", "lgd")
        .agg(
            rows().alias("accounts"),
            fixed(exact_mean("pd_score"), 4).alias("avg_pd"),
            fixed_sum("ead", 0).alias("total_ead"),
            fixed_sum(_loss(), 2).alias("total_expected_loss"),
            fixed(exact_mean(F.col("pd_score") * F.col("lgd")), 4).alias("avg_el_rate"),
        )
        .select(
            "product_type", "accounts", "avg_pd", "lgd", "total_ead", "total_expected_loss", "avg_el_rate"
        )
        .orderBy(F.desc_nulls_last("total_expected_loss"), "product_type")
    )


def monthly_reserve(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """Provision per month, from the month's default rate and exposure."""
    period_pd = fixed(ratio(F.count_if(dpd_at_least(cfg.default_dpd)), rows()), 4)
    return (
        p.statements.groupBy("period_month")
        .agg(exact_sum(exposure_at_default(cfg.ccf)).cast("double").alias("ead"), period_pd.alias("pd"))
        .withColumn("lgd", portfolio_lgd(p))
        .select(
            "period_month",
            fixed("ead", 0).alias("total_ead"),
            "pd",
            "lgd",
            fixed(F.col("pd") * F.col("lgd") * F.col("ead"), 2).alias("ecl_provision"),
            fixed(F.col("pd") * F.col("lgd") * 100.0, 4).alias("provision_rate_pct"),
        )
        .orderBy("period_month")
    )
