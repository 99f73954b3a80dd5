"""Advanced reports on the book: stress, concentration, retention, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revolva.functions import windows
from revolva.config import DEFAULTS, RiskConfig
from revolva.functions.bands import (
    BUCKET_SUFFIX,
    BUCKETS,
    dpd_at_least,
    lgd,
    payment_ratio,
    severity,
    utilization,
)
from revolva.functions.numeric import canonical, fixed, percent, ratio, rows, total
from revolva.operators.delinquency import total_exposure_by_month
from revolva.plans import panel, rollup, selection
from revolva.plans.portfolio import Portfolio


def cumulative_exposure(p: Portfolio) -> DataFrame:
    running = F.sum("monthly_exposure").over(windows.month_series())
    return total_exposure_by_month(p).withColumn("cumulative_exposure", running).orderBy("period_month")


def delinquency_bps(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """Monthly delinquency rate and its change in basis points."""
    rate = percent(F.count_if(dpd_at_least(cfg.delinquent_dpd)), rows(), 4)
    monthly = p.statements.groupBy("period_month").agg(rate.alias("del_rate"))
    return (
        monthly.withColumn("prev_rate", F.lag("del_rate").over(windows.month_series()))
        .withColumn("change_bps", fixed((F.col("del_rate") - F.col("prev_rate")) * 100, 2))
        .orderBy("period_month")
    )


def rolling_utilization(p: Portfolio) -> DataFrame:
    """Mean utilisation of a card's last three statements.

    Rows of a card come out together and in month order; there is no global sort.
    """
    return p.statements.select(
        "card_id",
        "period_month",
        fixed(utilization(), 4).alias("utilization"),
        fixed(F.avg(utilization()).over(windows.last_three()), 4).alias("util_3mo_avg"),
    ).sortWithinPartitions("card_id", "period_month")


def rfm_scoring(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """Recency, frequency and revolving amount per card, with exact quintiles; rows in no order."""
    late = dpd_at_least(cfg.delinquent_dpd)
    per_card = p.statements.groupBy("card_id").agg(
        F.max(F.when(late, F.col("period_month"))).alias("last_delinquent_month"),
        F.count_if(late).alias("frequency"),
        ratio(
            total(F.col("statement_balance") - F.col("paid_amount")),
            F.count(F.col("statement_balance") - F.col("paid_amount")),
        ).alias("revolving"),
    )
    card = selection.whole("card_id")
    tiled = selection.with_ntiles(
        per_card,
        5,
        freq_quintile=[selection.whole("frequency", descending=True), card],
        monetary_quintile=[selection.amount("revolving", descending=True), card],
    )
    return tiled.select(
        "card_id",
        "last_delinquent_month",
        "frequency",
        fixed("revolving", 2).alias("avg_revolving_bal"),
        "freq_quintile",
        "monetary_quintile",
    )


def payment_gap(p: Portfolio) -> DataFrame:
    return rollup.by_segment(
        rollup.card_profile(p),
        ["region", "income_band"],
        statements=F.sum("n"),
        avg_payment_gap=fixed(ratio(F.sum("gap"), F.sum("n")), 2),
        below_min_count=F.sum("n_below"),
        below_min_pct=rollup.share_of_statements("n_below"),
    ).orderBy(F.desc("below_min_pct"), "region", "income_band")


def stress_test(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """Exposure and delinquency rate under a balance and a delinquency shock."""
    hundredfold = F.count_if(dpd_at_least(cfg.delinquent_dpd)).cast("double") * 100.0
    rate = ratio(hundredfold, rows())
    return (
        p.statements.groupBy("period_month")
        .agg(
            total("statement_balance").alias("current_exposure"),
            fixed(F.sum("statement_balance") * cfg.balance_shock, 2).alias("stressed_exposure_25pct"),
            fixed(rate, 2).alias("current_del_rate"),
            fixed(rate * cfg.delinquency_shock, 2).alias("stressed_del_rate"),
        )
        .orderBy("period_month")
    )


def concentration(p: Portfolio, limit: int = 100) -> DataFrame:
    """Largest balances. Shares are of the whole book, orphan statements included."""
    book = p.statements.select(F.sum("statement_balance").alias("book")).scalar()
    return (
        rollup.by_segment(
            rollup.card_profile(p),
            ["customer_id", "region", "product_type"],
            total_balance=rollup.exposure(),
            max_dpd=F.max("max_dpd"),
        )
        .withColumn("pct_of_portfolio", percent("total_balance", book, 6))
        .orderBy(F.desc_nulls_last("total_balance"), "customer_id", "product_type")
        .limit(limit)
    )


def cohort_retention(p: Portfolio) -> DataFrame:
    """Active cards of each cohort per month.

    All cards of a cohort are active in its first month, so that month's count
    is the initial size and the statements are read once.
    """
    activity = (
        panel.aged(p.statements)
        .groupBy("cohort_month", "period_month")
        .agg(F.count_distinct("card_id").alias("active"))
    )
    start = F.when(F.col("period_month") == F.col("cohort_month"), F.col("active"))
    size = F.max(start).over(Window.partitionBy("cohort_month"))
    return (
        activity.withColumn("initial_size", size)
        .select(
            "cohort_month",
            "period_month",
            "initial_size",
            "active",
            percent("active", "initial_size").alias("retention_pct"),
        )
        .orderBy("cohort_month", "period_month")
    )


def collections_efficiency(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """What late cards pay on their next statement.

    The next payment is looked up before late rows are selected. A late row
    without a successor stays, with nothing recovered yet.
    """
    return (
        p.statements.select(
            "period_month",
            "statement_balance",
            "days_past_due",
            F.lead("paid_amount").over(windows.by_month()).alias("next_paid"),
        )
        .where(dpd_at_least(cfg.delinquent_dpd))
        .groupBy("period_month")
        .agg(
            rows().alias("delinquent_accounts"),
            total("statement_balance").alias("at_risk_balance"),
            total("next_paid").alias("recovered"),
        )
        .withColumn("recovery_rate_pct", percent("recovered", "at_risk_balance"))
        .orderBy("period_month")
    )


def risk_decile(p: Portfolio) -> DataFrame:
    """Risk score per card and limit, cut into exact deciles.

    Only the payment ratio is capped, statement by statement; a statement
    without a balance counts as fully paid. Deciles order by the score at ten
    decimals, so summation order cannot move a card. Rows come in no order.
    """
    paid = F.least(payment_ratio(), F.lit(1.0))
    score = F.col("util") * 40 + (F.col("dpd") / 90.0) * 40 + (1 - F.col("paid")) * 20
    scored = (
        p.statements.groupBy("card_id", "credit_limit")
        .agg(
            F.avg(utilization()).alias("util"),
            F.avg("days_past_due").alias("dpd"),
            F.avg(payment_ratio()).alias("payr"),
            F.avg(paid).alias("paid"),
        )
        .withColumn("score", canonical(score))
    )
    order = [selection.amount("score", descending=True), selection.whole("card_id"), selection.whole("credit_limit")]
    return selection.with_ntiles(scored, 10, risk_decile=order).select(
        "card_id",
        "credit_limit",
        fixed("util", 4).alias("avg_util"),
        fixed("dpd", 2).alias("avg_dpd"),
        fixed("payr", 4).alias("avg_pay_ratio"),
        fixed("score", 2).alias("risk_score"),
        "risk_decile",
    )


def lgd_proxy(p: Portfolio) -> DataFrame:
    return rollup.by_segment(
        rollup.card_profile(p),
        ["product_type", "income_band"],
        accounts=rollup.accounts(),
        total_exposure=rollup.exposure(),
        at_risk_exposure=F.sum("balance60"),
        lgd_proxy_pct=percent(F.sum("balance60"), F.sum("balance")),
    ).orderBy(F.desc_nulls_last("lgd_proxy_pct"), "product_type", "income_band")


def writeoffs_by_product_region(p: Portfolio) -> DataFrame:
    return (
        p.writeoffs.join(p.accounts, "card_id")
        .groupBy("product_type", "region")
        .agg(
            rows().alias("writeoffs"),
            total("writeoff_amount").alias("total_written_off"),
            total("recovery_amount").alias("total_recovered"),
            fixed(F.avg(lgd()), 4).alias("avg_lgd"),
            total(F.col("writeoff_amount") - F.col("recovery_amount")).alias("net_loss"),
        )
        .orderBy(F.desc("net_loss"), "product_type", "region")
    )


def limit_adequacy(p: Portfolio) -> DataFrame:
    return rollup.by_segment(
        rollup.card_profile(p),
        ["income_band", "product_type"],
        avg_limit=rollup.mean_limit(),
        avg_balance=rollup.mean_balance(0),
        avg_util=rollup.mean_util(),
        maxed_accounts=F.sum("n_maxed"),
        pct_maxed=rollup.share_of_statements("n_maxed"),
    ).orderBy(F.desc_nulls_last("avg_util"), "income_band", "product_type")


def migration_counts(p: Portfolio) -> DataFrame:
    """Number of moves from each bucket to each bucket."""
    counts = (
        panel.moves(p.statements)
        .groupBy("current_bucket")
        .pivot("next_bucket", list(BUCKETS))
        .agg(rows())
        .na.fill(0)
    )
    return counts.select(
        "current_bucket",
        *[F.col(f"`{b}`").alias(f"to_{BUCKET_SUFFIX[b]}") for b in BUCKETS],
        sum((F.col(f"`{b}`") for b in BUCKETS), F.lit(0).cast("bigint")).alias("total"),
    ).orderBy(severity("current_bucket"))


def activity_by_delinquency(p: Portfolio) -> DataFrame:
    """Spending by delinquency group. Groups have upper bounds only: a negative
    number of days falls into the first late group."""
    d = F.col("days_past_due")
    group = (
        F.when(d == 0, "Current")
        .when(d <= 29, "1-29 DPD")
        .when(d <= 59, "30-59 DPD")
        .when(d <= 89, "60-89 DPD")
        .otherwise("90+ DPD")
    )
    rank = severity(F.regexp_replace(F.regexp_replace("dpd_group", " DPD", ""), "Current", "0"))
    return (
        p.statements.groupBy(group.alias("dpd_group"))
        .agg(
            rows().alias("account_months"),
            fixed(F.avg("transaction_amount"), 2).alias("avg_transaction"),
            fixed(F.avg("statement_balance"), 2).alias("avg_balance"),
            fixed(F.avg(ratio("transaction_amount", "statement_balance")), 4).alias("tx_to_balance_ratio"),
        )
        .orderBy(rank)
    )
