"""Delinquency trends, cures, early warnings and streaks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revolva.functions import windows
from revolva.config import DEFAULTS, RiskConfig
from revolva.functions.bands import (
    BUCKET_SUFFIX,
    BUCKETS,
    DELINQUENT_BUCKETS,
    dpd_at_least,
    severity,
)
from revolva.functions.numeric import fixed, percent, rows, total, total_if
from revolva.operators import features
from revolva.operators.kpis import monthly_counts
from revolva.plans import panel
from revolva.plans.portfolio import Portfolio



def month_on_month(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """Monthly rates; the change is the difference of the rounded rates."""
    rate = lambda c: percent(c, "total_accounts")
    monthly = monthly_counts(p, cfg).select(
        "period_month",
        F.col("total_accounts").alias("total"),
        F.col("dpd_30plus").alias("delinquent"),
        F.col("total_exposure").alias("exposure"),
        rate("dpd_30plus").alias("del_rate_pct"),
        rate("dpd_60plus").alias("dpd60_rate_pct"),
        rate("dpd_90plus").alias("dpd90_rate_pct"),
    )
    change = F.col("del_rate_pct") - F.lag("del_rate_pct").over(windows.month_series())
    return monthly.withColumn("mom_change_pct", fixed(change, 2)).orderBy("period_month")


def cure_rate(p: Portfolio) -> DataFrame:
    """Share of late statements that are current, or worse, one statement later."""
    worse = severity("next_bucket") > severity("current_bucket")
    return (
        panel.moves(p.statements)
        .where(F.col("current_bucket").isin(list(BUCKETS[1:])))
        .groupBy("current_bucket")
        .agg(
            rows().alias("total_transitions"),
            F.count_if(F.col("next_bucket") == "0").alias("cured"),
            F.count_if(worse).alias("worsened"),
        )
        .select(
            "current_bucket",
            "total_transitions",
            "cured",
            percent("cured", "total_transitions").alias("cure_rate_pct"),
            percent("worsened", "total_transitions").alias("worsening_rate_pct"),
        )
        .orderBy(severity("current_bucket"))
    )


def warning_summary(p: Portfolio) -> DataFrame:
    groups = features.early_warning(p).groupBy("ewi_flag").agg(
        rows().alias("occurrences"),
        F.count_distinct("card_id").alias("unique_accounts"),
        fixed(F.avg("days_past_due"), 2).alias("avg_current_dpd"),
    )
    return groups.select(
        "ewi_flag",
        "occurrences",
        "unique_accounts",
        percent("occurrences", F.sum("occurrences").over(windows.all_groups())).alias("pct"),
        "avg_current_dpd",
    ).orderBy(F.desc("occurrences"), "ewi_flag")


def delinquency_streaks(p: Portfolio, limit: int = 100, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """Longest run of consecutive late statements per card.

    The number of punctual statements so far is constant within a run and
    differs between runs, so one ordered pass labels all runs.
    """
    late = F.coalesce(dpd_at_least(cfg.delinquent_dpd), F.lit(False))
    run = F.count_if(~late).over(windows.up_to_now(windows.by_month()))
    return (
        p.statements.select("card_id", late.alias("late"), run.alias("run"))
        .where("late")
        .groupBy("card_id", "run")
        .agg(rows().alias("length"))
        .groupBy("card_id")
        .agg(F.max("length").alias("max_consecutive_delinquent_months"))
        .where(F.col("max_consecutive_delinquent_months") >= cfg.streak_months)
        .orderBy(F.desc("max_consecutive_delinquent_months"), "card_id")
        .limit(limit)
    )


def balance_migration(p: Portfolio) -> DataFrame:
    """Monthly exposure per bucket, and the delinquent share of all of it."""
    name = {b: "current_bal" if b == "0" else f"b_{BUCKET_SUFFIX[b]}" for b in BUCKETS}
    per_bucket = p.statements.groupBy("period_month").agg(
        *[total_if(F.col("dpd_bucket") == b, "statement_balance").alias(name[b]) for b in BUCKETS]
    )
    add = lambda names: reduce(lambda a, b: a + b, [F.col(n) for n in names])
    late = add([name[b] for b in DELINQUENT_BUCKETS])
    return per_bucket.select(
        "period_month",
        *name.values(),
        late.alias("total_delinquent_bal"),
        percent(late, add(name.values())).alias("delinquent_bal_pct"),
    ).orderBy("period_month")


def first_payment_default(p: Portfolio, limit: int = 200, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """Cards already late within their first statements."""
    early = F.col("position") <= cfg.early_statements
    return (
        panel.numbered(p.statements, "position")
        .groupBy("card_id")
        .agg(
            F.max(F.when(early, F.col("days_past_due")).otherwise(0)).alias("max_early_dpd"),
            F.count_if(early & dpd_at_least(cfg.delinquent_dpd)).alias("early_delinquent_months"),
        )
        .where(F.col("early_delinquent_months") > 0)
        .orderBy(F.desc("max_early_dpd"), "card_id")
        .limit(limit)
    )


def total_exposure_by_month(p: Portfolio) -> DataFrame:
    return p.statements.groupBy("period_month").agg(total("statement_balance").alias("monthly_exposure"))
