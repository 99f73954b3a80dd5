"""Conditions that single rows of a table must not meet, as they are counted while a table is read or written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from revolva.functions.bands import bucket_of


def _missing(*columns: str) -> dict[str, Callable[[], Column]]:
    return {f"null_{c}": lambda c=c: F.col(c).isNull() for c in columns}


STATEMENT_ISSUES = {
    "negative_balance": lambda: F.col("statement_balance") < 0,
    "negative_dpd": lambda: F.col("days_past_due") < 0,
    "overpayment": lambda: F.col("paid_amount") > F.col("statement_balance"),
    "over_limit": lambda: F.col("statement_balance") > F.col("credit_limit"),
    "dpd_bucket_mismatch": lambda: bucket_of("days_past_due") != F.col("dpd_bucket"),
}
CARD_ISSUES = {"bad_credit_limit": lambda: F.col("credit_limit") <= 0}
WRITEOFF_ISSUES = {
    "negative_writeoff": lambda: F.col("writeoff_amount") <= 0,
    "recovery_exceeds_writeoff": lambda: F.col("recovery_amount") > F.col("writeoff_amount"),
}

#: All row checks of a table; one scan counts them together.
ROW_CHECKS = {
    "customers": _missing("customer_id", "region", "income_band"),
    "cards": _missing("card_id", "customer_id", "credit_limit") | CARD_ISSUES,
    "statements": _missing("statement_balance", "paid_amount", "days_past_due", "credit_limit") | STATEMENT_ISSUES,
    "writeoffs": WRITEOFF_ISSUES,
}
