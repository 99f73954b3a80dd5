"""Per-card ordered views of the statement panel.

Every frame here uses one window specification, so a query pays for one
exchange and one sort on the card, and for no exchange on a table bucketed by
``card_id``. A window group is one card. With (card, month) unique, which
``quality.duplicate_statements`` checks, a group holds one row per calendar
month, whatever the size of the portfolio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revolva.functions.bands import months_between
from revolva.functions.windows import by_card, by_month


def transitions(statements: DataFrame) -> DataFrame:
    """Each statement beside the card's next observed one; the last has none."""
    nxt = lambda c: F.lead(c).over(by_month())
    return statements.select(
        "card_id",
        F.col("period_month").alias("current_month"),
        F.col("dpd_bucket").alias("current_bucket"),
        nxt("period_month").alias("next_month"),
        nxt("dpd_bucket").alias("next_bucket"),
        F.col("statement_balance").alias("current_balance"),
        nxt("statement_balance").alias("next_balance"),
    )


def moves(statements: DataFrame) -> DataFrame:
    """Transitions that have a next statement."""
    return transitions(statements).where(F.col("next_month").isNotNull())


def aged(statements: DataFrame) -> DataFrame:
    """Statements with the card's first month and 0-based months on book."""
    first = F.min("period_month").over(by_card())
    return statements.withColumn("cohort_month", first).withColumn(
        "mob", months_between("period_month", "cohort_month")
    )


def numbered(statements: DataFrame, name: str = "mob") -> DataFrame:
    """Statements with the 1-based position of the statement on its card."""
    return statements.withColumn(name, F.row_number().over(by_month()))


def previous(c: str) -> Column:
    return F.lag(c).over(by_month())
