"""The six feature views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revolva.config import DEFAULTS, RiskConfig
from revolva.functions.bands import dpd_at_least, payment_ratio, payment_type, util_band, utilization
from revolva.functions.numeric import fixed, total
from revolva.plans import panel
from revolva.plans.portfolio import Portfolio


def credit_utilization(p: Portfolio) -> DataFrame:
    """Utilisation of the limit in force at statement time, and its band."""
    return p.statements.join(p.cards.select("card_id", "customer_id"), "card_id").select(
        "card_id",
        "customer_id",
        "period_month",
        "statement_balance",
        "credit_limit",
        fixed(utilization(), 4).alias("utilization_ratio"),
        util_band(utilization()).alias("utilization_band"),
    )


def payment_behavior(p: Portfolio) -> DataFrame:
    return p.statements.select(
        "card_id",
        "period_month",
        "statement_balance",
        "min_due",
        "paid_amount",
        "days_past_due",
        "dpd_bucket",
        fixed(payment_ratio(), 4).alias("payment_ratio"),
        payment_type().alias("payment_type"),
        (F.col("statement_balance") - F.col("paid_amount")).alias("revolving_balance"),
    )


def customer_risk_profile(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """Whole-life behaviour per card. The limit shown is the card's present one."""
    behaviour = p.statements.groupBy("card_id").agg(
        F.avg(utilization()).alias("avg_utilization"),
        F.max(utilization()).alias("max_utilization"),
        F.max("days_past_due").alias("max_dpd_ever"),
        F.avg("days_past_due").alias("avg_dpd"),
        F.count_if(dpd_at_least(cfg.delinquent_dpd)).alias("months_delinquent"),
        F.count_if(dpd_at_least(cfg.default_dpd)).alias("months_default"),
        F.avg(payment_ratio()).alias("avg_payment_ratio"),
        F.avg("statement_balance").alias("avg_balance"),
        F.count("period_month").alias("months_on_book"),
        total("transaction_amount").alias("total_transactions"),
    )
    paid = F.col("avg_payment_ratio")
    capped = lambda c: F.least(c, F.lit(1.0))
    score = (
        capped(F.col("avg_utilization")) * 40
        + capped(F.col("avg_dpd") / 90.0) * 40
        + (1 - capped(paid)) * 20
    )
    return (
        behaviour.join(p.accounts, "card_id")
        .withColumn(
            "customer_segment",
            F.when(paid >= 0.95, "Transactor").when(paid >= 0.50, "Revolving").otherwise("Distressed"),
        )
        .withColumn("risk_score", fixed(score, 2))
        .select(
            "card_id",
            "customer_id",
            "region",
            "income_band",
            "product_type",
            F.col("card_limit").alias("credit_limit"),
            "avg_utilization",
            "max_utilization",
            "max_dpd_ever",
            "avg_dpd",
            "months_delinquent",
            "months_default",
            "avg_payment_ratio",
            "avg_balance",
            "months_on_book",
            "total_transactions",
            "customer_segment",
            "risk_score",
        )
    )


def roll_rate_base(p: Portfolio) -> DataFrame:
    """Every statement that has a successor on its card, beside that successor."""
    return panel.moves(p.statements)


def vintage_base(p: Portfolio) -> DataFrame:
    return panel.aged(p.statements).select(
        "card_id",
        "cohort_month",
        "period_month",
        "mob",
        "statement_balance",
        "days_past_due",
        "dpd_bucket",
        "credit_limit",
    )


def early_warning(p: Portfolio) -> DataFrame:
    """Month-on-month stress flags. A card's first statement has no flag."""
    lagged = p.statements.select(
        "card_id",
        "period_month",
        "statement_balance",
        "days_past_due",
        "paid_amount",
        "dpd_bucket",
        panel.previous("statement_balance").alias("prev_balance"),
        panel.previous("days_past_due").alias("prev_dpd"),
        panel.previous("paid_amount").alias("prev_paid"),
        panel.previous("dpd_bucket").alias("prev_bucket"),
    )
    later = F.col("days_past_due") > F.col("prev_dpd")
    owes_more = F.col("statement_balance") > F.col("prev_balance")
    pays_less = F.col("paid_amount") < F.col("prev_paid")
    flag = (
        F.when(later & owes_more & pays_less, "TRIPLE WARNING")
        .when(later & owes_more, "DOUBLE WARNING")
        .when((F.col("days_past_due") > 0) & (F.col("prev_dpd") == 0), "NEWLY DELINQUENT")
        .when((F.col("days_past_due") == 0) & (F.col("prev_dpd") > 0), "CURED")
        .otherwise("NORMAL")
    )
    return lagged.where(F.col("prev_balance").isNotNull()).withColumn("ewi_flag", flag)


# Names under which the views are registered for SQL users.
VIEWS = {
    "vw_credit_utilization": credit_utilization,
    "vw_payment_behavior": payment_behavior,
    "vw_customer_risk_profile": customer_risk_profile,
    "vw_roll_rate_base": roll_rate_base,
    "vw_vintage_base": vintage_base,
    "vw_early_warning_indicators": early_warning,
}
