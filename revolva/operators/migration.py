"""Roll rates: how statements move between delinquency buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revolva.functions.bands import BUCKET_SUFFIX, BUCKETS, DELINQUENT_BUCKETS, WATCH_BUCKETS, severity
from revolva.functions.numeric import fixed, percent, ratio, rows, total, total_if
from revolva.plans import panel
from revolva.plans.portfolio import Portfolio


def _goes_to(bucket: str):
    return F.col("next_bucket") == bucket


def roll_matrix(p: Portfolio) -> DataFrame:
    """Moves from each bucket to each bucket, as counts and row percentages."""
    counts = panel.moves(p.statements).groupBy("current_bucket").agg(
        rows().alias("total_accounts"),
        *[F.count_if(_goes_to(b)).alias(f"roll_to_{BUCKET_SUFFIX[b]}") for b in BUCKETS],
    )
    shares = [
        percent(f"roll_to_{suffix}", "total_accounts").alias(f"pct_to_{suffix}")
        for suffix in BUCKET_SUFFIX.values()
    ]
    return counts.select("*", *shares).orderBy(severity("current_bucket"))


def roll_matrix_balance(p: Portfolio) -> DataFrame:
    """The matrix weighted by the balance before the move."""
    sums = panel.moves(p.statements).groupBy("current_bucket").agg(
        total("current_balance").alias("total_balance"),
        *[
            total_if(_goes_to(b), "current_balance").alias(f"bal_to_{BUCKET_SUFFIX[b]}")
            for b in BUCKETS
        ],
    )
    shares = [
        percent(f"bal_to_{BUCKET_SUFFIX[b]}", "total_balance").alias(f"bal_roll_to_{BUCKET_SUFFIX[b]}_pct")
        for b in DELINQUENT_BUCKETS
    ]
    return sums.select("*", *shares).orderBy(severity("current_bucket"))


def roll_trend(p: Portfolio) -> DataFrame:
    """Monthly share of late statements that worsen, improve or stay.

    "Cure" means any improvement here.
    """
    before, after = severity("current_bucket"), severity("next_bucket")
    return (
        panel.moves(p.statements)
        .where(F.col("current_bucket") != "0")
        .groupBy("current_month", "current_bucket")
        .agg(
            rows().alias("accounts"),
            percent(F.count_if(after > before), rows()).alias("forward_roll_rate_pct"),
            percent(F.count_if(after < before), rows()).alias("cure_rate_pct"),
            percent(F.count_if(after == before), rows()).alias("stable_rate_pct"),
        )
        .orderBy("current_month", severity("current_bucket"))
    )


def net_roll(p: Portfolio) -> DataFrame:
    """Arrivals in each late bucket less cures out of it.

    An arrival counts every statement that is late next, whether or not it
    stayed in its bucket. Each move yields its arrival and its departure in one
    pass, and both combine before the shuffle.
    """
    arrival = F.when(
        F.col("next_bucket") != "0",
        F.struct(
            F.col("next_month").alias("month"),
            F.col("next_bucket").alias("bucket"),
            F.lit(1).alias("accounts"),
            F.col("next_balance").cast("bigint").alias("balance"),
        ),
    )
    departure = F.when(
        (F.col("current_bucket") != "0") & (F.col("next_bucket") == "0"),
        F.struct(
            F.col("current_month").alias("month"),
            F.col("current_bucket").alias("bucket"),
            F.lit(-1).alias("accounts"),
            (-F.col("current_balance").cast("bigint")).alias("balance"),
        ),
    )
    return (
        panel.moves(p.statements)
        .select(F.inline(F.array_compact(F.array(arrival, departure))))
        .groupBy("month", "bucket")
        .agg(
            F.sum("accounts").alias("net_account_flow"),
            F.sum("balance").alias("net_balance_flow"),
        )
        .orderBy("month", severity("bucket"))
    )


def roll_by_region(p: Portfolio) -> DataFrame:
    """New delinquency and flow into default by region and bucket.

    Moves are counted per card and bucket before the join with the dimensions.
    """
    newly_late = F.col("next_bucket").isin(list(DELINQUENT_BUCKETS)) & F.col("current_bucket").isin(
        list(WATCH_BUCKETS)
    )
    into_default = (F.col("next_bucket") == "90+") & (F.col("current_bucket") != "90+")
    per_card = panel.moves(p.statements).groupBy("card_id", "current_bucket").agg(
        rows().alias("n"),
        F.count_if(newly_late).alias("n_late"),
        F.count_if(into_default).alias("n_default"),
    )
    return (
        per_card.join(p.accounts.select("card_id", "region"), "card_id")
        .groupBy("region", "current_bucket")
        .agg(
            F.sum("n").alias("accounts"),
            percent(F.sum("n_late"), F.sum("n")).alias("new_delinquency_rate_pct"),
            percent(F.sum("n_default"), F.sum("n")).alias("charge_off_flow_pct"),
        )
        .orderBy("region", severity("current_bucket"))
    )


def loss_projection(p: Portfolio) -> DataFrame:
    """Balance of the last month expected to reach default one step later.

    The last month's balances and the lifetime roll rates come from one pass:
    a statement without a successor adds nothing to the rates.
    """
    moved = F.col("next_month").isNotNull()
    latest = F.col("current_month") == p.latest_month()
    rate = fixed(
        ratio(F.count_if(moved & _goes_to("90+")), F.count_if(moved)), 4
    )
    return (
        panel.transitions(p.statements)
        .groupBy(F.col("current_bucket").alias("dpd_bucket"))
        .agg(
            F.count_if(latest).alias("accounts"),
            F.sum(F.when(latest, F.col("current_balance").cast("bigint"))).alias("balance"),
            F.coalesce(rate, F.lit(0.0)).alias("projected_default_rate"),
        )
        .where(F.col("accounts") > 0)
        .withColumn(
            "projected_default_balance",
            fixed(F.col("balance") * F.col("projected_default_rate"), 0),
        )
        .orderBy(severity("dpd_bucket"))
    )
