"""Vintage curves: cohorts of cards followed by months on book (0-based)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revolva.functions import windows
from revolva.config import DEFAULTS, RiskConfig
from revolva.functions.bands import dpd_at_least
from revolva.functions.numeric import fixed, percent, ratio, rows, total
from revolva.plans import panel
from revolva.plans.portfolio import Portfolio


def _counts(groups, cfg: RiskConfig) -> DataFrame:
    return groups.agg(
        rows().alias("accounts"),
        F.count_if(dpd_at_least(cfg.delinquent_dpd)).alias("delinquent_30plus"),
        F.count_if(dpd_at_least(cfg.default_dpd)).alias("defaulted"),
        total("statement_balance").alias("outstanding_balance"),
    )


def curves(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return (
        _counts(panel.aged(p.statements).groupBy("cohort_month", "mob"), cfg)
        .select(
            "*",
            percent("delinquent_30plus", "accounts", 4).alias("delinquency_rate_pct"),
            percent("defaulted", "accounts", 4).alias("default_rate_pct"),
        )
        .orderBy("cohort_month", "mob")
    )


def cumulative(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """Share of the cards seen at an age that defaulted at or before it.

    A card without a statement at an age is not counted there.
    """
    hit = F.max(F.coalesce(dpd_at_least(cfg.default_dpd), F.lit(False)))
    so_far = windows.up_to_now(windows.by_card().orderBy("mob"))
    return (
        panel.aged(p.statements)
        .groupBy("card_id", "cohort_month", "mob")
        .agg(hit.alias("hit"))
        .withColumn("hit", F.max("hit").over(so_far))
        .groupBy("cohort_month", "mob")
        .agg(rows().alias("accounts_at_mob"), F.count_if("hit").alias("cumulative_defaults"))
        .withColumn(
            "cumulative_default_rate_pct", percent("cumulative_defaults", "accounts_at_mob", 4)
        )
        .orderBy("cohort_month", "mob")
    )


def key_ages(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """Default rate of each cohort at fixed ages, NULL where an age is missing."""
    at = lambda m: F.col("mob") == m
    defaulted = dpd_at_least(cfg.default_dpd)
    return (
        panel.aged(p.statements)
        .groupBy("cohort_month")
        .agg(
            *[
                percent(F.count_if(at(m) & defaulted), F.count_if(at(m)), 4).alias(f"default_rate_mob{m}")
                for m in cfg.key_mobs
            ]
        )
        .orderBy("cohort_month")
    )


def loss_rate(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """Net write-offs of each cohort against its balance at origination.

    Origination is the age ``origination_mob``, by default one month on book.
    Cohorts without a statement at that age are left out. Statements and
    write-offs are both reduced to one row per card before they meet.
    """
    at_start = F.col("mob") == cfg.origination_mob
    per_card = panel.aged(p.statements).groupBy("card_id", "cohort_month").agg(
        F.count_if(at_start).alias("n_start"),
        F.sum(F.when(at_start, F.col("statement_balance").cast("bigint"))).alias("start_balance"),
    )
    losses = p.writeoffs.groupBy("card_id").agg(
        total("writeoff_amount").alias("lost"), total("recovery_amount").alias("won_back")
    )
    zero = F.lit(0).cast("bigint")
    return (
        per_card.join(losses, "card_id", "left")
        .groupBy("cohort_month")
        .agg(
            F.sum("n_start").alias("n_start"),
            F.sum("start_balance").alias("original_balance"),
            F.coalesce(F.sum("lost"), zero).alias("written_off"),
            F.coalesce(F.sum("won_back"), zero).alias("recovered"),
        )
        .where(F.col("n_start") > 0)
        .drop("n_start")
        .withColumn("net_loss", F.col("written_off") - F.col("recovered"))
        .withColumn("net_loss_rate_pct", percent("net_loss", "original_balance", 4))
        .orderBy("cohort_month")
    )


def by_income(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return (
        _counts(
            panel.aged(p.statements)
            .join(p.accounts.select("card_id", "income_band"), "card_id")
            .groupBy("income_band", "cohort_month", "mob"),
            cfg,
        )
        .select(
            "income_band",
            "cohort_month",
            "mob",
            "accounts",
            percent("delinquent_30plus", "accounts", 4).alias("del_rate_pct"),
            percent("defaulted", "accounts", 4).alias("default_rate_pct"),
        )
        .orderBy("income_band", "cohort_month", "mob")
    )


def scorecard(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """Annual summary, from one row per card."""
    per_card = p.statements.groupBy("card_id").agg(
        F.min("period_month").alias("cohort_month"),
        rows().alias("n"),
        total("statement_balance").alias("balance"),
        F.count_if(dpd_at_least(cfg.delinquent_dpd)).alias("n30"),
        F.count_if(dpd_at_least(cfg.default_dpd)).alias("n90"),
        F.max("days_past_due").alias("max_dpd"),
    )
    return (
        per_card.groupBy(F.trunc("cohort_month", "YEAR").alias("vintage_year"))
        .agg(
            rows().alias("total_accounts"),
            F.count_distinct("cohort_month").alias("months_in_vintage"),
            fixed(ratio(F.sum("balance"), F.sum("n")), 0).alias("avg_balance"),
            percent(F.sum("n30"), F.sum("n"), 4).alias("avg_del_rate_pct"),
            percent(F.sum("n90"), F.sum("n"), 4).alias("avg_default_rate_pct"),
            F.max("max_dpd").alias("peak_dpd_observed"),
        )
        .orderBy("vintage_year")
    )


def early_life(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """Cards late, or in default, within their first months on book."""
    early = F.col("mob") <= cfg.early_mob
    per_card = panel.aged(p.statements).groupBy("card_id", "cohort_month").agg(
        F.max(F.when(early, F.col("days_past_due")).otherwise(0)).alias("worst")
    )
    late, defaulted = F.col("worst") >= cfg.delinquent_dpd, F.col("worst") >= cfg.default_dpd
    return (
        per_card.groupBy("cohort_month")
        .agg(
            rows().alias("total_accounts"),
            F.count_if(late).alias("early_delinquent"),
            F.count_if(defaulted).alias("early_default"),
        )
        .select(
            "*",
            percent("early_delinquent", "total_accounts", 4).alias("early_del_rate_pct"),
            percent("early_default", "total_accounts", 4).alias("early_default_rate_pct"),
        )
        .orderBy("cohort_month")
    )
