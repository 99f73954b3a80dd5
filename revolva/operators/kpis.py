"""Portfolio key figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revolva.functions import windows
from revolva.config import DEFAULTS, RiskConfig
from revolva.functions.bands import dpd_at_least, payment_ratio, payment_type, severity, util_band, utilization
from revolva.functions.numeric import fixed, percent, rows, total, total_if
from revolva.plans import rollup
from revolva.plans.portfolio import Portfolio



def portfolio_summary(p: Portfolio) -> DataFrame:
    """One row. Delinquent and default "accounts" count statements."""
    profile = rollup.card_rollup(p.statements).join(p.cards.select("card_id", "customer_id"), "card_id")
    return profile.agg(
        F.count_distinct("customer_id").alias("total_customers"),
        rollup.accounts().alias("total_accounts"),
        rollup.exposure().alias("total_exposure"),
        rollup.mean_balance(2).alias("avg_balance"),
        rollup.mean_util().alias("avg_utilization"),
        F.sum("n30").alias("delinquent_accounts"),
        F.sum("n90").alias("default_accounts"),
        rollup.share_of_statements("n30").alias("delinquency_rate_pct"),
        rollup.share_of_statements("n90").alias("default_rate_pct"),
    )


def by_bucket(p: Portfolio) -> DataFrame:
    groups = p.statements.groupBy("dpd_bucket").agg(
        rows().alias("account_months"),
        F.count_distinct("card_id").alias("unique_accounts"),
        total("statement_balance").alias("total_exposure"),
    )
    share = percent("account_months", F.sum("account_months").over(windows.all_groups()))
    return groups.withColumn("pct_of_portfolio", share).orderBy(severity("dpd_bucket"))


def by_util_band(p: Portfolio) -> DataFrame:
    return (
        p.statements.groupBy(util_band(utilization()).alias("util_band"))
        .agg(
            rows().alias("account_months"),
            F.count_distinct("card_id").alias("unique_accounts"),
            total("statement_balance").alias("exposure"),
            fixed(F.avg("days_past_due"), 2).alias("avg_dpd"),
        )
        .orderBy("util_band")
    )


def by_payment_type(p: Portfolio) -> DataFrame:
    groups = p.statements.groupBy(payment_type().alias("payment_type")).agg(
        rows().alias("occurrences"),
        total(F.col("statement_balance") - F.col("paid_amount")).alias("revolving_balance"),
        fixed(F.avg("days_past_due"), 2).alias("avg_dpd"),
    )
    return groups.select(
        "payment_type",
        "occurrences",
        percent("occurrences", F.sum("occurrences").over(windows.all_groups())).alias("pct"),
        "revolving_balance",
        "avg_dpd",
    ).orderBy(F.desc("occurrences"), "payment_type")


def by_region(p: Portfolio) -> DataFrame:
    return rollup.by_segment(
        rollup.card_profile(p),
        ["region"],
        accounts=rollup.accounts(),
        total_exposure=rollup.exposure(),
        avg_utilization=rollup.mean_util(),
        del_rate_pct=rollup.share_of_statements("n30"),
        default_rate_pct=rollup.share_of_statements("n90"),
        avg_payment_ratio=rollup.mean_payment_ratio(),
    ).orderBy(F.desc("del_rate_pct"), "region")


def by_income(p: Portfolio) -> DataFrame:
    return rollup.by_segment(
        rollup.card_profile(p),
        ["income_band"],
        accounts=rollup.accounts(),
        avg_limit=rollup.mean_limit(),
        avg_balance=rollup.mean_balance(0),
        avg_utilization=rollup.mean_util(),
        del_rate_pct=rollup.share_of_statements("n30"),
        default_rate_pct=rollup.share_of_statements("n90"),
    ).orderBy(F.desc("del_rate_pct"), "income_band")


def by_product(p: Portfolio) -> DataFrame:
    cards = p.cards.select("card_id", "product_type", F.col("credit_limit").alias("card_limit"))
    return rollup.by_segment(
        rollup.card_rollup(p.statements).join(cards, "card_id"),
        ["product_type"],
        accounts=rollup.accounts(),
        avg_limit=rollup.mean_limit(),
        total_exposure=rollup.exposure(),
        avg_utilization=rollup.mean_util(),
        del_rate_pct=rollup.share_of_statements("n30"),
        default_rate_pct=rollup.share_of_statements("n90"),
    ).orderBy(F.desc("del_rate_pct"), "product_type")


def monthly_counts(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    late = dpd_at_least(cfg.delinquent_dpd)
    return p.statements.groupBy("period_month").agg(
        rows().alias("total_accounts"),
        F.count_if(late).alias("dpd_30plus"),
        F.count_if(dpd_at_least(cfg.serious_dpd)).alias("dpd_60plus"),
        F.count_if(dpd_at_least(cfg.default_dpd)).alias("dpd_90plus"),
        total("statement_balance").alias("total_exposure"),
        total_if(late, "statement_balance").alias("at_risk_exposure"),
    )


def monthly_trend(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    rate = percent("dpd_30plus", "total_accounts")
    return monthly_counts(p, cfg).withColumn("del_rate_pct", rate).orderBy("period_month")


def top_risk_accounts(p: Portfolio, limit: int = 50) -> DataFrame:
    """The worst statements of the last month; the card breaks ties."""
    return (
        p.latest_statements()
        .join(p.accounts, "card_id")
        .select(
            "card_id",
            "region",
            "income_band",
            "product_type",
            F.col("card_limit").alias("credit_limit"),
            "statement_balance",
            fixed(utilization(), 4).alias("utilization"),
            "days_past_due",
            "dpd_bucket",
            fixed(payment_ratio(), 4).alias("payment_ratio"),
        )
        .orderBy(F.desc_nulls_last("days_past_due"), F.desc_nulls_last("statement_balance"), "card_id")
        .limit(limit)
    )
