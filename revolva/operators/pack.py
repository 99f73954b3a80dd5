"""The monthly reports from one scan: grouping sets over one partial aggregate.

Statements are first reduced to cells, one for each month, bucket and payment type that occurs:
some hundred rows, whatever the size of the portfolio. The grouping sets expand these cells
and not the statements. Each report is a filter of the pack, so a pack that is stored once
(a few hundred rows) serves all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revolva.config import DEFAULTS, RiskConfig
from revolva.functions import windows
from revolva.functions.bands import BUCKETS, dpd_at_least, payment_type
from revolva.functions.numeric import fixed, percent, ratio, rows, total, total_if
from revolva.plans.portfolio import Portfolio

KEYS = ("period_month", "dpd_bucket", "payment_type")
#: Report name to its keys.
SETS = {
    "month": ["period_month"],
    "bucket": ["dpd_bucket"],
    "payment": ["payment_type"],
    "month and bucket": ["period_month", "dpd_bucket"],
}
MEASURES = (
    "statements", "dpd_30plus", "dpd_60plus", "dpd_90plus", "balance", "late_balance", "revolving", "dpd", "with_dpd"
)


def cells(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """Sums of the additive measures for each month, bucket and payment type."""
    late = dpd_at_least(cfg.delinquent_dpd)
    return p.statements.groupBy("period_month", "dpd_bucket", payment_type().alias("payment_type")).agg(
        rows().alias("statements"),
        F.count_if(late).alias("dpd_30plus"),
        F.count_if(dpd_at_least(cfg.serious_dpd)).alias("dpd_60plus"),
        F.count_if(dpd_at_least(cfg.default_dpd)).alias("dpd_90plus"),
        total("statement_balance").alias("balance"),
        total_if(late, "statement_balance").alias("late_balance"),
        total(F.col("statement_balance") - F.col("paid_amount")).alias("revolving"),
        total("days_past_due").alias("dpd"),
        F.count("days_past_due").alias("with_dpd"),
    )


def pack(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """report, period_month, dpd_bucket, payment_type and the measures: the rows of all reports of ``SETS``.

    Keys that a report does not group by are NULL.
    """
    kept = lambda k: F.grouping(k) == 0
    named = F.when(kept("payment_type"), "payment").when(kept("period_month") & kept("dpd_bucket"), "month and bucket")
    named = named.when(kept("period_month"), "month").otherwise("bucket")
    return (
        cells(p, cfg)
        .groupingSets(list(SETS.values()), *KEYS)
        .agg(named.alias("report"), *[F.sum(m).alias(m) for m in MEASURES])
        .select("report", *KEYS, *MEASURES)
    )


def _report(packed: DataFrame, name: str) -> DataFrame:
    return packed.where(F.col("report") == name).select(*SETS[name], *MEASURES)


def monthly_trend(packed: DataFrame) -> DataFrame:
    return (
        _report(packed, "month")
        .select(
            "period_month",
            F.col("statements").alias("total_accounts"),
            "dpd_30plus",
            "dpd_60plus",
            "dpd_90plus",
            F.col("balance").alias("total_exposure"),
            F.col("late_balance").alias("at_risk_exposure"),
            percent("dpd_30plus", "statements").alias("del_rate_pct"),
        )
        .orderBy("period_month")
    )


def month_on_month(packed: DataFrame) -> DataFrame:
    """Monthly rates; the change is the difference of the rounded rates."""
    monthly = _report(packed, "month").select(
        "period_month",
        F.col("statements").alias("total"),
        F.col("dpd_30plus").alias("delinquent"),
        F.col("balance").alias("exposure"),
        percent("dpd_30plus", "statements").alias("del_rate_pct"),
        percent("dpd_60plus", "statements").alias("dpd60_rate_pct"),
        percent("dpd_90plus", "statements").alias("dpd90_rate_pct"),
    )
    change = F.col("del_rate_pct") - F.lag("del_rate_pct").over(windows.month_series())
    return monthly.withColumn("mom_change_pct", fixed(change, 2)).orderBy("period_month")


def payment_types(packed: DataFrame) -> DataFrame:
    return (
        _report(packed, "payment")
        .select(
            "payment_type",
            F.col("statements").alias("occurrences"),
            percent("statements", F.sum("statements").over(windows.all_groups())).alias("pct"),
            F.col("revolving").alias("revolving_balance"),
            fixed(ratio("dpd", "with_dpd"), 2).alias("avg_dpd"),
        )
        .orderBy(F.desc("occurrences"), "payment_type")
    )


def bucket_distribution(packed: DataFrame) -> DataFrame:
    """Statements per bucket; all five buckets are listed, empty ones with zero."""
    of = lambda b: F.coalesce(F.sum(F.when(F.col("dpd_bucket") == b, F.col("statements"))), F.lit(0))
    counts = _report(packed, "bucket").agg(*[of(b).alias(b) for b in BUCKETS])
    pairs = [F.struct(F.lit(b).alias("dpd_bucket"), F.col(f"`{b}`").alias("account_months")) for b in BUCKETS]
    return counts.select(F.inline(F.array(*pairs)))


def monthly_rates(packed: DataFrame) -> DataFrame:
    return (
        _report(packed, "month")
        .select(
            "period_month",
            F.col("statements").alias("total"),
            F.col("dpd_30plus").alias("del30"),
            F.col("dpd_90plus").alias("def90"),
            F.col("balance").alias("exposure"),
            (ratio("dpd_30plus", "statements") * 100).alias("del_rate"),
            (ratio("dpd_90plus", "statements") * 100).alias("def_rate"),
        )
        .orderBy("period_month")
    )
