"""Card-level partial aggregates that segment reports are built from.

Region, income and product do not vary within a card. Statements are therefore
reduced to one row per card before the dimensions are joined: the join moves
cards instead of statements, and a count of distinct cards becomes a count of
rows. Columns a report does not use are pruned by the optimizer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revolva.config import DEFAULTS, RiskConfig
from revolva.functions.bands import dpd_at_least, payment_ratio, utilization
from revolva.functions.numeric import fixed, percent, ratio, rows, total, total_if
from revolva.plans.portfolio import Portfolio


def card_rollup(statements: DataFrame, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    util, payr = utilization(), payment_ratio()
    below = F.col("paid_amount") < F.col("min_due")
    return statements.groupBy("card_id").agg(
        rows().alias("n"),
        F.count_if(dpd_at_least(cfg.delinquent_dpd)).alias("n30"),
        F.count_if(dpd_at_least(cfg.serious_dpd)).alias("n60"),
        F.count_if(dpd_at_least(cfg.default_dpd)).alias("n90"),
        F.max("days_past_due").alias("max_dpd"),
        total("days_past_due").alias("dpd"),
        total("statement_balance").alias("balance"),
        total_if(dpd_at_least(cfg.serious_dpd), "statement_balance").alias("balance60"),
        F.sum(util).alias("util"),
        F.count(util).alias("n_util"),
        F.sum(payr).alias("payr"),
        F.count(payr).alias("n_payr"),
        F.count_if(util > cfg.maxed_utilization).alias("n_maxed"),
        F.count_if(below).alias("n_below"),
        total(F.greatest(F.col("min_due") - F.col("paid_amount"), F.lit(0))).alias("gap"),
    )


def card_profile(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """The roll-up of every card that has a customer, with its dimensions."""
    return card_rollup(p.statements, cfg).join(p.accounts, "card_id")


def by_segment(profile: DataFrame, keys: Sequence[str], **measures: Column) -> DataFrame:
    return profile.groupBy(*keys).agg(*[c.alias(name) for name, c in measures.items()])


# Measures over a card profile. Averages are per statement, not per card.


def accounts() -> Column:
    return rows()


def exposure() -> Column:
    return F.sum("balance")


def mean_balance(digits: int) -> Column:
    return fixed(ratio(F.sum("balance"), F.sum("n")), digits)


def mean_limit(digits: int = 0) -> Column:
    """Mean card limit, weighted by the card's statements."""
    weighted = F.col("card_limit").cast("bigint") * F.col("n")
    return fixed(ratio(F.sum(weighted), F.sum("n")), digits)


def mean_util() -> Column:
    return fixed(ratio(F.sum("util"), F.sum("n_util")), 4)


def mean_payment_ratio() -> Column:
    return fixed(ratio(F.sum("payr"), F.sum("n_payr")), 4)


def share_of_statements(counter: str, digits: int = 2) -> Column:
    return percent(F.sum(counter), F.sum("n"), digits)
