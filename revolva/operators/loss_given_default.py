"""Loss given default, from the write-offs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revolva.functions import windows
from revolva.functions.bands import lgd
from revolva.functions.numeric import fixed, percent, ratio, rows, total
from revolva.plans.portfolio import Portfolio


def _net() -> Column:
    return F.col("writeoff_amount") - F.col("recovery_amount")


def _mean_lgd() -> Column:
    return fixed(F.avg(lgd()), 4)


def _recovery_pct() -> Column:
    return percent(total("recovery_amount"), total("writeoff_amount"))


def portfolio_lgd(p: Portfolio) -> DataFrame:
    """Mean loss share per write-off beside the amount-weighted one."""
    return p.writeoffs.agg(
        rows().alias("total_writeoffs"),
        total("writeoff_amount").alias("total_written_off"),
        total("recovery_amount").alias("total_recovered"),
        total(_net()).alias("total_net_loss"),
        _mean_lgd().alias("avg_lgd"),
        percent(total(_net()), total("writeoff_amount")).alias("portfolio_lgd_pct"),
        _recovery_pct().alias("recovery_rate_pct"),
    )


def _by(df: DataFrame, *keys: Column | str, net: bool = False) -> DataFrame:
    return df.groupBy(*keys).agg(
        rows().alias("writeoffs"),
        total("writeoff_amount").alias("total_written_off"),
        total("recovery_amount").alias("total_recovered"),
        *([total(_net()).alias("net_loss")] if net else []),
        _mean_lgd().alias("avg_lgd"),
        _recovery_pct().alias("recovery_rate_pct"),
    )


def lgd_by_product(p: Portfolio) -> DataFrame:
    held = p.writeoffs.join(p.cards.select("card_id", "product_type"), "card_id")
    return _by(held, "product_type", net=True).orderBy(F.desc_nulls_last("avg_lgd"), "product_type")


def lgd_by_income(p: Portfolio) -> DataFrame:
    held = p.writeoffs.join(p.accounts, "card_id")
    return _by(held, "income_band").orderBy(F.desc_nulls_last("avg_lgd"), "income_band")


def lgd_by_region(p: Portfolio) -> DataFrame:
    held = p.writeoffs.join(p.accounts, "card_id")
    return _by(held, "region").orderBy(F.desc_nulls_last("avg_lgd"), "region")


def lgd_by_month(p: Portfolio) -> DataFrame:
    month = F.trunc("writeoff_date", "MM").alias("writeoff_month")
    return _by(p.writeoffs, month).orderBy("writeoff_month")


def lgd_histogram(p: Portfolio) -> DataFrame:
    band = (
        F.when(lgd() < 0.20, "0-20% (Low Loss)")
        .when(lgd() < 0.40, "20-40%")
        .when(lgd() < 0.60, "40-60%")
        .when(lgd() < 0.80, "60-80%")
        .otherwise("80-100% (High Loss)")
    )
    groups = p.writeoffs.groupBy(band.alias("lgd_band")).agg(
        rows().alias("writeoffs"),
        total("writeoff_amount").alias("total_exposure"),
        total(_net()).alias("net_loss"),
    )
    everything = F.sum("writeoffs").over(windows.all_groups())
    return groups.withColumn("pct_of_writeoffs", percent("writeoffs", everything)).orderBy("lgd_band")


def lgd_account_detail(p: Portfolio, ordered: bool = False) -> DataFrame:
    """Every write-off of a known customer; ``ordered`` sorts all of them, the worst first."""
    found = (
        p.writeoffs.join(p.accounts, "card_id")
        .select(
            "card_id",
            "product_type",
            "region",
            "income_band",
            F.col("card_limit").alias("credit_limit"),
            "writeoff_amount",
            "recovery_amount",
            _net().alias("net_loss"),
            fixed(lgd(), 4).alias("lgd"),
            fixed(ratio("recovery_amount", "writeoff_amount"), 4).alias("recovery_rate"),
            "writeoff_date",
        )
    )
    return found.orderBy(F.desc_nulls_last("lgd"), F.desc("net_loss"), "card_id") if ordered else found


def lgd_by_limit_band(p: Portfolio) -> DataFrame:
    limit = F.col("credit_limit")
    band = (
        F.when(limit < 50_000, "Low (<50K)")
        .when(limit < 150_000, "Medium (50K-150K)")
        .when(limit < 400_000, "High (150K-400K)")
        .otherwise("Premium (400K+)")
    )
    return (
        p.writeoffs.join(p.cards.select("card_id", "credit_limit"), "card_id")
        .groupBy(band.alias("limit_band"))
        .agg(
            rows().alias("writeoffs"),
            fixed(F.avg("credit_limit"), 0).alias("avg_limit"),
            fixed(F.avg("writeoff_amount"), 0).alias("avg_writeoff"),
            _mean_lgd().alias("avg_lgd"),
        )
        .orderBy(F.desc_nulls_last("avg_lgd"), "limit_band")
    )
