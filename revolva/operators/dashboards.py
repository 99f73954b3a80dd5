"""Calculations that dashboards make on the extracts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revolva.functions import windows
from revolva.functions.bands import DELINQUENT_BUCKETS, WATCH_BUCKETS
from revolva.functions.numeric import fixed, percent, ratio, rows, total
from revolva.operators import charts, exports, frames
from revolva.plans import panel
from revolva.plans.portfolio import Portfolio


def filtered_overview(
    p: Portfolio,
    regions: list[str] | None = None,
    income_bands: list[str] | None = None,
    product_types: list[str] | None = None,
    first_month: date | None = None,
    last_month: date | None = None,
) -> DataFrame:
    """The whole master table under the dashboard's filters."""
    df = frames.master_features(p)
    for name, wanted in (("region", regions), ("income_band", income_bands), ("product_type", product_types)):
        if wanted is not None:
            df = df.where(F.col(name).isin(wanted))
    if first_month is not None:
        df = df.where(F.col("period_month") >= F.lit(first_month))
    if last_month is not None:
        df = df.where(F.col("period_month") <= F.lit(last_month))
    return df


def overview_cards(p: Portfolio, **filters) -> DataFrame:
    return filtered_overview(p, **filters).agg(
        total("statement_balance").alias("total_exposure"),
        F.avg("is_delinquent").alias("delinquency_rate"),
        F.avg("is_default").alias("default_rate"),
        frames.mean4("utilization").alias("avg_utilization"),
    )


def overview_breakdown(p: Portfolio, **filters) -> DataFrame:
    """Statements per bucket, utilisation band and payment type, in one pass."""
    kinds = ("dpd_bucket", "util_band", "payment_type")
    pairs = [F.struct(F.lit(k).alias("dimension"), F.col(k).alias("label")) for k in kinds]
    return (
        filtered_overview(p, **filters)
        .select(F.inline(F.array(*pairs)))
        .groupBy("dimension", "label")
        .agg(rows().alias("accounts"))
        .orderBy("dimension", "label")
    )


def running_average_change(p: Portfolio) -> DataFrame:
    """Change of the running mean of the monthly delinquency rate."""
    so_far = F.avg("del_rate").over(windows.up_to_now(windows.month_series()))
    running = charts.monthly_rates(p).select("period_month", "del_rate", so_far.alias("running"))
    return running.select(
        "period_month",
        fixed("del_rate", 8).alias("del_rate"),
        fixed("running", 8).alias("running_avg"),
        fixed(F.col("running") - F.lag("running").over(windows.month_series()), 8).alias("running_avg_change"),
    ).orderBy("period_month")


def vintage_at_age(p: Portfolio, mob: int = 12) -> DataFrame:
    return (
        frames.cohort_rates(p)
        .where(F.col("mob") == mob)
        .select("cohort_month", "default_rate")
        .orderBy("cohort_month")
    )


def cohort_heatmap(p: Portfolio) -> DataFrame:
    return frames.cohort_rates(p).select(
        "cohort_month", "mob", "delinquency_rate", "accounts", "defaulted"
    )


def forward_roll_trend(p: Portfolio) -> DataFrame:
    """Monthly share of current and watch-list cards that become late next."""
    becomes_late = F.col("next_bucket").isin(list(DELINQUENT_BUCKETS))
    return (
        panel.moves(p.statements)
        .where(F.col("current_bucket").isin(list(WATCH_BUCKETS)))
        .groupBy("current_month")
        .agg(rows().alias("accounts"), F.count_if(becomes_late).alias("rolled"))
        .withColumn("forward_roll_pct", percent("rolled", "accounts"))
        .orderBy("current_month")
    )


def region_delinquency(p: Portfolio) -> DataFrame:
    """Unweighted mean over the segments of a region."""
    return (
        exports.segment_measures(p)
        .groupBy("region")
        .agg(fixed(F.avg("del_rate"), 8).alias("avg_del_rate"))
        .orderBy(F.desc("avg_del_rate"), "region")
    )


def income_scatter(p: Portfolio) -> DataFrame:
    return (
        exports.segment_measures(p)
        .groupBy("income_band")
        .agg(
            fixed(F.avg("avg_util"), 8).alias("avg_util"),
            fixed(F.avg("del_rate"), 8).alias("del_rate"),
            F.sum("accounts").alias("accounts"),
        )
        .orderBy("income_band")
    )


def product_income_heatmap(p: Portfolio) -> DataFrame:
    return (
        exports.segment_measures(p)
        .groupBy("product_type", "income_band")
        .agg(fixed(F.avg("del_rate"), 8).alias("del_rate"))
        .orderBy("product_type", "income_band")
    )


def exposure_treemap(p: Portfolio) -> DataFrame:
    return (
        exports.segment_measures(p)
        .groupBy("region", "income_band")
        .agg(F.sum("exposure").alias("exposure"), fixed(F.avg("del_rate"), 8).alias("del_rate"))
        .orderBy(F.desc("exposure"), "region", "income_band")
    )


def loss_cards(p: Portfolio) -> DataFrame:
    return exports.expected_loss(p).agg(
        frames.cents("expected_loss").alias("total_expected_loss"),
        frames.mean4("pd_score").alias("avg_pd_score"),
        fixed(F.avg("lgd"), 8).alias("avg_lgd"),
        fixed(ratio(frames.cents("expected_loss"), F.sum("ead")), 8).alias("el_rate"),
    )


def stage_charts(p: Portfolio) -> DataFrame:
    return (
        exports.expected_loss(p)
        .groupBy("ifrs9_stage")
        .agg(rows().alias("accounts"), frames.cents("expected_loss").alias("expected_loss"))
        .orderBy("ifrs9_stage")
    )


def score_bins(p: Portfolio) -> DataFrame:
    """Cards per score bin of 0.05, binned on whole ten-thousandths."""
    units = F.rint(F.col("pd_score") * 10_000).cast("bigint")
    return (
        exports.expected_loss(p)
        .groupBy((F.floor(units / 500) * 5 / 100).alias("pd_bin"))
        .agg(rows().alias("accounts"))
        .orderBy("pd_bin")
    )


def top_losses(p: Portfolio, limit: int = 50) -> DataFrame:
    return (
        exports.expected_loss(p)
        .select(
            "card_id",
            "region",
            "product_type",
            "ead",
            "pd_score",
            "expected_loss",
            "el_rate_pct",
            "ifrs9_stage",
        )
        .orderBy(F.desc_nulls_last("expected_loss"), "card_id")
        .limit(limit)
    )


def loss_rate_heatmap(p: Portfolio) -> DataFrame:
    return (
        exports.expected_loss(p)
        .groupBy("product_type", "income_band")
        .agg(frames.mean4("el_rate_pct").alias("avg_el_rate_pct"))
        .orderBy("product_type", "income_band")
    )
