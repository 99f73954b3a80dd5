"""The datasets behind the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revolva.functions import windows
from revolva.config import DEFAULTS, RiskConfig
from revolva.functions.bands import BUCKETS, dpd_at_least
from revolva.functions.numeric import ratio, rows, total
from revolva.operators import frames
from revolva.plans.portfolio import Portfolio

HISTOGRAM_BINS = 40


def bucket_distribution(p: Portfolio) -> DataFrame:
    """Statements per bucket; all five buckets are listed, empty ones with zero."""
    counts = p.statements.agg(*[F.count_if(F.col("dpd_bucket") == b).alias(b) for b in BUCKETS])
    pairs = [F.struct(F.lit(b).alias("dpd_bucket"), F.col(f"`{b}`").alias("account_months")) for b in BUCKETS]
    return counts.select(F.inline(F.array(*pairs)))


def util_distribution(p: Portfolio) -> DataFrame:
    return (
        frames.features(p.statements)
        .where(F.col("util_band").isNotNull())
        .groupBy("util_band")
        .agg(rows().alias("account_months"))
        .orderBy(F.desc("account_months"), "util_band")
    )


def monthly_rates(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return (
        p.statements.groupBy("period_month")
        .agg(
            rows().alias("total"),
            F.count_if(dpd_at_least(cfg.delinquent_dpd)).alias("del30"),
            F.count_if(dpd_at_least(cfg.default_dpd)).alias("def90"),
            total("statement_balance").alias("exposure"),
        )
        .select(
            "*",
            (ratio("del30", "total") * 100).alias("del_rate"),
            (ratio("def90", "total") * 100).alias("def_rate"),
        )
    )


def monthly_trend(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return monthly_rates(p, cfg).orderBy("period_month")


def vintage_sampled(p: Portfolio, step: int = 3, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """Curves of every third cohort, the first one included."""
    nth = F.dense_rank().over(windows.all_groups().orderBy("cohort_month"))
    return (
        frames.cohort_rates(p, cfg)
        .withColumn("nth", nth)
        .where((F.col("nth") - 1) % step == 0)
        .select("cohort_month", "mob", "default_rate")
        .orderBy("cohort_month", "mob")
    )


def stage_distribution(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return (
        frames.expected_loss(p, cfg)
        .groupBy("ifrs9_stage")
        .agg(rows().alias("accounts"))
        .orderBy(F.desc("accounts"), "ifrs9_stage")
    )


def loss_by_stage(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return (
        frames.expected_loss(p, cfg)
        .groupBy("ifrs9_stage")
        .agg(frames.cents("expected_loss").alias("expected_loss"))
        .orderBy("ifrs9_stage")
    )


def pd_histogram(p: Portfolio, bins: int = HISTOGRAM_BINS, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """Cards per equal-width bin of the score; the last bin holds its upper edge.

    A score has four decimals, so the scores are first counted per value: at
    most 10,001 rows go on to be binned, from one pass over the cards. At most
    ``bins`` counts are then collected, to list the empty bins too.
    """
    counted = (
        frames.pd_scores(p, cfg)
        .where(F.col("pd_score").isNotNull())
        .groupBy("pd_score")
        .agg(rows().alias("n"))
        .select("pd_score", "n", F.min("pd_score").over(windows.all_groups()).alias("low"), F.max("pd_score").over(windows.all_groups()).alias("high"))
    )
    width = (F.col("high") - F.col("low")) / bins
    nth = F.floor((F.col("pd_score") - F.col("low")) / F.nullif(width, F.lit(0.0)))
    bin_no = F.least(F.coalesce(nth, F.lit(0)), F.lit(bins - 1)).cast("int")
    per_bin = counted.groupBy("low", "high", bin_no.alias("bin")).agg(F.sum("n").alias("n"))
    found = per_bin.groupBy("low", "high").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("counts")
    )
    return found.select(
        "low", "high", "counts", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    ).select(
        "bin",
        (F.col("low") + F.col("bin") * width).alias("bin_start"),
        (F.col("low") + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce(F.element_at("counts", F.col("bin")), F.lit(0)).alias("accounts"),
    )


def region_util(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return frames.util_by(p, "region", cfg)


def income_util(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return frames.util_by(p, "income_band", cfg)
