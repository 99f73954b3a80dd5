"""Division and rounding rules.

Ratios are doubles with NULL for a zero denominator. Reports round half away
from zero, and do so through DECIMAL(28,10): a double that differs in its last
bits because its terms were summed in another order then still rounds alike.
The dataframe-style variants round half to even, as numpy does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CANONICAL = "decimal(28,10)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical(c: Column | str) -> Column:
    """A double as a decimal that no longer depends on summation order."""
    return col(c).cast(_CANONICAL)


def fixed(c: Column | str, digits: int) -> Column:
    """Round half away from zero."""
    return F.round(canonical(c), digits).cast("double")


def displayed(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """A frame with some columns rounded for output."""
    return df.withColumns({c: fixed(c, digits) for c in columns})


def half_even(c: Column | str, digits: int) -> Column:
    """Round half to even on the scaled double, as numpy does."""
    scale = float(10**digits)
    return F.rint(col(c).cast("double") * scale) / scale


def ratio(num: Column | str, den: Column | str) -> Column:
    """Double division, NULL on a zero denominator."""
    return col(num).cast("double") / F.nullif(col(den).cast("double"), F.lit(0.0))


def percent(num: Column | str, den: Column | str, digits: int = 2) -> Column:
    """``num`` as a rounded percentage of ``den``."""
    hundredfold = col(num).cast("double") * 100.0
    return fixed(ratio(hundredfold, den), digits)


def total(c: Column | str) -> Column:
    return F.sum(col(c).cast("bigint"))


def total_if(condition: Column, c: Column | str) -> Column:
    """Sum over the rows that meet a condition; zero, not NULL, when none does."""
    return F.sum(F.when(condition, col(c).cast("bigint")).otherwise(F.lit(0).cast("bigint")))


def exact_sum(c: Column | str) -> Column:
    """Sum of amounts at ten decimals as a wide decimal.

    Whole numbers are added up, so the result is the same for every partitioning and order of rows,
    to the last digit, up to 28 digits before the point.
    """
    return F.sum(canonical(c))


def exact_mean(c: Column | str) -> Column:
    return ratio(exact_sum(c), F.count(col(c)))


def fixed_sum(c: Column | str, digits: int) -> Column:
    """An exact sum, rounded half away from zero."""
    return F.round(exact_sum(c), digits).cast("double")


def rows() -> Column:
    return F.count(F.lit(1))
