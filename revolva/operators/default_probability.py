"""Probability of default: observed rates and the behavioural score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revolva.functions import windows
from revolva.config import DEFAULTS, RiskConfig
from revolva.functions.bands import dpd_at_least, logistic, payment_ratio, util_band, utilization
from revolva.functions.numeric import fixed, percent, ratio, rows
from revolva.plans import panel, rollup
from revolva.plans.portfolio import Portfolio


def _ever(cfg: RiskConfig) -> Column:
    return F.count_if(F.col("max_dpd") >= cfg.default_dpd)


def portfolio_pd(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """Share of cards that ever reached default."""
    return rollup.card_rollup(p.statements, cfg).agg(
        _ever(cfg).alias("defaulted_accounts"),
        rows().alias("total_accounts"),
        percent(_ever(cfg), rows(), 4).alias("pd_pct"),
    )


def monthly_pd(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """Monthly default rate and its moving mean over three observed months."""
    monthly = p.statements.groupBy("period_month").agg(
        rows().alias("total_accounts"), F.count_if(dpd_at_least(cfg.default_dpd)).alias("defaults")
    )
    rate = ratio(F.col("defaults").cast("double") * 100.0, "total_accounts")
    return monthly.select(
        "*",
        fixed(rate, 4).alias("pd_pct"),
        fixed(F.avg(rate).over(windows.month_series().rowsBetween(-2, 0)), 4).alias("pd_3mo_avg"),
    ).orderBy("period_month")


def _segment_pd(profile: DataFrame, key: str, cfg: RiskConfig, **more: Column) -> DataFrame:
    return rollup.by_segment(
        profile,
        [key],
        accounts=rollup.accounts(),
        defaults=_ever(cfg),
        pd_pct=percent(_ever(cfg), rows(), 4),
        **more,
    ).orderBy(F.desc("pd_pct"), key)


def pd_by_region(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return _segment_pd(rollup.card_profile(p, cfg), "region", cfg)


def pd_by_income(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return _segment_pd(rollup.card_profile(p, cfg), "income_band", cfg, avg_limit=rollup.mean_limit())


def pd_by_product(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    profile = rollup.card_rollup(p.statements, cfg).join(p.cards.select("card_id", "product_type"), "card_id")
    return _segment_pd(profile, "product_type", cfg)


def _statement_pd(groups, cfg: RiskConfig, counted: str) -> DataFrame:
    return groups.agg(
        rows().alias(counted), F.count_if(dpd_at_least(cfg.default_dpd)).alias("defaults")
    ).withColumn("pd_pct", percent("defaults", counted, 4))


def pd_by_util_band(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    groups = p.statements.groupBy(util_band(utilization()).alias("utilization_band"))
    return _statement_pd(groups, cfg, "account_months").orderBy(F.desc("pd_pct"), "utilization_band")


def pd_by_age(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """Default rate by the 1-based number of the statement on its card."""
    return _statement_pd(panel.numbered(p.statements).groupBy("mob"), cfg, "accounts").orderBy("mob")


def risk_driver(util: Column, dpd: Column, late_months: Column, payr: Column, cfg: RiskConfig) -> Column:
    """The linear part of the behavioural default score."""
    s = cfg.score
    return (
        F.lit(s.intercept)
        + util * s.utilization
        + (dpd / 30.0) * s.dpd_per_30_days
        + late_months * s.delinquent_month
        + payr * s.payment_ratio
    )


def score_12m(p: Portfolio, cfg: RiskConfig = DEFAULTS, ordered: bool = False) -> DataFrame:
    """Behavioural score per card and limit, from features rounded beforehand.

    Without any payment ratio there is no score, which reads as stage 1. ``ordered`` sorts
    all cards, the highest score first.
    """
    behaviour = p.statements.groupBy("card_id", "credit_limit").agg(
        fixed(F.avg(utilization()), 4).alias("avg_util"),
        fixed(F.avg("days_past_due"), 4).alias("avg_dpd"),
        F.max("days_past_due").alias("max_dpd"),
        F.count_if(dpd_at_least(cfg.delinquent_dpd)).alias("del_months"),
        fixed(F.avg(payment_ratio()), 4).alias("avg_pay_ratio"),
        F.count("period_month").alias("months_on_book"),
    )
    driver = risk_driver(
        F.col("avg_util"), F.col("avg_dpd"), F.col("del_months"), F.col("avg_pay_ratio"), cfg
    )
    stage = (
        F.when(F.col("pd_score_12m") >= cfg.stage_3_score, "Stage 3 (Default)")
        .when(F.col("pd_score_12m") >= cfg.stage_2_score, "Stage 2 (Significant Increase)")
        .otherwise("Stage 1 (Performing)")
    )
    found = (
        behaviour.drop("credit_limit")
        .withColumn("pd_score_12m", fixed(logistic(driver), 4))
        .withColumn("ifrs9_stage", stage)
    )
    return found.orderBy(F.desc_nulls_last("pd_score_12m"), "card_id") if ordered else found
