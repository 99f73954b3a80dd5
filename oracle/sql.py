"""Helpers that write DuckDB SQL fragments and put queries together."""

from __future__ import annotations


def rnd(x: str, n: int) -> str:
    """Round half away from zero through DECIMAL(28,10)."""
    return f"CAST(round(CAST({x} AS DECIMAL(28,10)), {n}) AS DOUBLE)"


def whole(x: str) -> str:
    """Round a sum of quarters to a whole number. Such sums are exact doubles,

    while a cast to ten decimals is not exact above about a million.
    """
    return f"round(CAST({x} AS DOUBLE))"


def even(x: str, n: int) -> str:
    """Round half to even on the scaled double."""
    return f"(round_even(CAST({x} AS DOUBLE) * 1e{n}, 0) / 1e{n})"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def pct(a: str, b: str, n: int = 2) -> str:
    return rnd(f"CAST({a} AS DOUBLE) * 1e2 / nullif(CAST({b} AS DOUBLE), 0)", n)


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def total(x: str) -> str:
    return big(f"sum({x})")


def total_if(condition: str, x: str) -> str:
    return big(f"coalesce(sum({x}) FILTER ({condition}), 0)")


def n_if(condition: str) -> str:
    return f"count(*) FILTER ({condition})"


def mean4(x: str) -> str:
    """Exact mean of values that have four decimals."""
    return f"(CAST(sum(CAST(round_even({x} * 1e4, 0) AS BIGINT)) AS DOUBLE) / nullif(count({x}), 0) / 1e4)"


def cents(x: str) -> str:
    return f"coalesce(CAST(sum(CAST(round_even({x} * 1e2, 0) AS BIGINT)) AS DOUBLE) / 1e2, CAST(0 AS DOUBLE))"


UTIL = div("statement_balance", "credit_limit")
PAYR = div("paid_amount", "statement_balance")
LGD = div("writeoff_amount - recovery_amount", "writeoff_amount")
EAD = "(statement_balance + 0.75e0 * (credit_limit - statement_balance))"
NET = "writeoff_amount - recovery_amount"
LATE, SERIOUS, DEFAULT = "days_past_due >= 30", "days_past_due >= 60", "days_past_due >= 90"


def ladder(x: str, op: str, steps: list[tuple[str, str]], other: str) -> str:
    whens = " ".join(f"WHEN {x} {op} {edge} THEN '{label}'" for edge, label in steps)
    return f"CASE {whens} ELSE '{other}' END"


UTIL_BAND = ladder(
    UTIL, ">=", [("0.9e0", "Critical 90%+"), ("0.7e0", "High 70-89%"), ("0.4e0", "Medium 40-69%")], "Low <40%"
)
PAYMENT_TYPE = (
    "CASE WHEN paid_amount >= statement_balance THEN 'Full Payment' WHEN paid_amount >= min_due THEN 'Min Payment'"
    " WHEN paid_amount > 0 THEN 'Partial Payment' ELSE 'No Payment' END"
)


def score(util: str, dpd: str, late: str, payr: str) -> str:
    z = f"-3.5e0 + ({util}) * 2.5e0 + (({dpd}) / 30e0) * 1.8e0 + ({late}) * 0.4e0 + ({payr}) * -1.5e0"
    return f"1e0 / (1e0 + exp(-({z})))"


def rank(bucket: str) -> str:
    return f"list_position(['0', '1-29', '30-59', '60-89', '90+'], {bucket})"
