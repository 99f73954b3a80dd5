"""Window specifications.

Card windows hold one row per calendar month as long as (card, month) is
unique. The other two run over frames that are already aggregated: one row per
label of a closed domain, or one row per calendar month.
"""

from __future__ import annotations

from pyspark.sql import Window, WindowSpec
from pyspark.sql import functions as F


def by_card() -> WindowSpec:
    return Window.partitionBy("card_id")


def by_month() -> WindowSpec:
    """A card's statements in month order."""
    return by_card().orderBy("period_month")


def last_three() -> WindowSpec:
    """The present and the two previous statements of a card."""
    return by_month().rowsBetween(-2, Window.currentRow)


def up_to_now(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before_now(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, -1)


def all_groups() -> WindowSpec:
    """All rows of a small aggregated frame."""
    return Window.partitionBy(F.lit(0))


def month_series() -> WindowSpec:
    """The rows of a monthly aggregate in month order."""
    return all_groups().orderBy("period_month")
