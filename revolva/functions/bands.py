"""Closed label domains and the expressions that assign them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revolva.functions.numeric import col, ratio

# Delinquency buckets in severity order, and the column suffix of each.
BUCKETS = ("0", "1-29", "30-59", "60-89", "90+")
BUCKET_SUFFIX = {
    "0": "current",
    "1-29": "1_29",
    "30-59": "30_59",
    "60-89": "60_89",
    "90+": "90_plus",
}
WATCH_BUCKETS = ("0", "1-29")
DELINQUENT_BUCKETS = ("30-59", "60-89", "90+")

# Utilisation bands, lower edge first.
UTIL_LOW = "Low <40%"
UTIL_MEDIUM = "Medium 40-69%"
UTIL_HIGH = "High 70-89%"
UTIL_CRITICAL = "Critical 90%+"
UTIL_BANDS = (UTIL_LOW, UTIL_MEDIUM, UTIL_HIGH, UTIL_CRITICAL)

STAGES = ("Stage 1", "Stage 2", "Stage 3")


def bucket_of(dpd: Column | str) -> Column:
    """The bucket that a non-negative number of days past due belongs to."""
    d = col(dpd)
    return (
        F.when(d == 0, "0")
        .when(d.between(1, 29), "1-29")
        .when(d.between(30, 59), "30-59")
        .when(d.between(60, 89), "60-89")
        .when(d >= 90, "90+")
    )


def severity(bucket: Column | str) -> Column:
    """Rank 1..5 of a bucket label, NULL for an unknown one."""
    labels = F.array(*[F.lit(b) for b in BUCKETS])
    return F.nullif(F.array_position(labels, col(bucket)).cast("int"), F.lit(0))


def utilization() -> Column:
    return ratio("statement_balance", "credit_limit")


def payment_ratio() -> Column:
    return ratio("paid_amount", "statement_balance")


def util_band(u: Column) -> Column:
    """Bands closed on the left; an unknown ratio counts as low."""
    return (
        F.when(u >= 0.9, UTIL_CRITICAL)
        .when(u >= 0.7, UTIL_HIGH)
        .when(u >= 0.4, UTIL_MEDIUM)
        .otherwise(UTIL_LOW)
    )


def util_band_right_closed(u: Column) -> Column:
    """Bands closed on the right; an unknown or negative ratio has no band."""
    return (
        F.when((u > -0.001) & (u <= 0.4), UTIL_LOW)
        .when((u > 0.4) & (u <= 0.7), UTIL_MEDIUM)
        .when((u > 0.7) & (u <= 0.9), UTIL_HIGH)
        .when(u > 0.9, UTIL_CRITICAL)
    )


def payment_type() -> Column:
    paid = F.col("paid_amount")
    return (
        F.when(paid >= F.col("statement_balance"), "Full Payment")
        .when(paid >= F.col("min_due"), "Min Payment")
        .when(paid > 0, "Partial Payment")
        .otherwise("No Payment")
    )


def dpd_at_least(days: int) -> Column:
    return F.col("days_past_due") >= days


def months_between(later: Column | str, earlier: Column | str) -> Column:
    """Whole calendar months between two month starts."""
    a, b = col(later), col(earlier)
    return ((F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)).cast("int")


def lgd() -> Column:
    """Share of a write-off that was not recovered."""
    return ratio(F.col("writeoff_amount") - F.col("recovery_amount"), "writeoff_amount")


def exposure_at_default(ccf: float) -> Column:
    """Balance plus the part of the open limit expected to be drawn.

    Over-limit rows have a negative open limit, which is kept as it is.
    """
    balance = F.col("statement_balance").cast("double")
    return balance + F.lit(float(ccf)) * (F.col("credit_limit") - F.col("statement_balance"))


def logistic(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))
