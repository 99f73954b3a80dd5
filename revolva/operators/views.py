"""The six feature views as SQL text over the tables of a stored portfolio.

A view is created from text, so a catalog that outlives the session keeps it, and any SQL
user can read and change it. The operators in ``features`` give the same rows.
"""

from __future__ import annotations

from revolva.config import DEFAULTS, RiskConfig
from revolva.functions.bands import UTIL_CRITICAL, UTIL_HIGH, UTIL_LOW, UTIL_MEDIUM


def _ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0D))"


def _fixed(x: str, digits: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28,10)), {digits}) AS DOUBLE)"


def texts(tables: dict[str, str], cfg: RiskConfig = DEFAULTS) -> dict[str, str]:
    """View name to query; ``tables`` names customers, cards and statements in the catalog."""
    customers, cards, statements = (tables[t] for t in ("customers", "cards", "statements"))
    used, paid = _ratio("statement_balance", "credit_limit"), _ratio("paid_amount", "statement_balance")
    month = "OVER (PARTITION BY card_id ORDER BY period_month)"
    later = ", ".join(f"lead({c}) {month} AS next_{n}" for c, n in (("period_month", "month"), ("dpd_bucket", "bucket"), ("statement_balance", "balance")))
    before = {"balance": "statement_balance", "dpd": "days_past_due", "paid": "paid_amount", "bucket": "dpd_bucket"}
    prior = ", ".join(f"lag({c}) {month} AS prev_{n}" for n, c in before.items())
    first = "min(period_month) OVER (PARTITION BY card_id)"
    return {
        "vw_credit_utilization": f"""
            SELECT s.card_id, c.customer_id, s.period_month, s.statement_balance, s.credit_limit,
                   {_fixed('s.used', 4)} AS utilization_ratio,
                   CASE WHEN s.used >= 0.9 THEN '{UTIL_CRITICAL}' WHEN s.used >= 0.7 THEN '{UTIL_HIGH}'
                        WHEN s.used >= 0.4 THEN '{UTIL_MEDIUM}' ELSE '{UTIL_LOW}' END AS utilization_band
            FROM (SELECT *, {used} AS used FROM {statements}) s JOIN {cards} c ON s.card_id = c.card_id""",
        "vw_payment_behavior": f"""
            SELECT card_id, period_month, statement_balance, min_due, paid_amount, days_past_due, dpd_bucket,
                   {_fixed(paid, 4)} AS payment_ratio,
                   CASE WHEN paid_amount >= statement_balance THEN 'Full Payment' WHEN paid_amount >= min_due THEN 'Min Payment'
                        WHEN paid_amount > 0 THEN 'Partial Payment' ELSE 'No Payment' END AS payment_type,
                   statement_balance - paid_amount AS revolving_balance
            FROM {statements}""",
        "vw_customer_risk_profile": f"""
            SELECT c.card_id, c.customer_id, u.region, u.income_band, c.product_type, c.credit_limit,
                   b.avg_utilization, b.max_utilization, b.max_dpd_ever, b.avg_dpd, b.months_delinquent, b.months_default,
                   b.avg_payment_ratio, b.avg_balance, b.months_on_book, b.total_transactions,
                   CASE WHEN b.avg_payment_ratio >= 0.95 THEN 'Transactor' WHEN b.avg_payment_ratio >= 0.5 THEN 'Revolving'
                        ELSE 'Distressed' END AS customer_segment,
                   {_fixed('least(b.avg_utilization, 1D) * 40 + least(b.avg_dpd / 90D, 1D) * 40 + (1 - least(b.avg_payment_ratio, 1D)) * 20', 2)}
                     AS risk_score
            FROM (
              SELECT card_id, avg({used}) AS avg_utilization, max({used}) AS max_utilization, max(days_past_due) AS max_dpd_ever,
                     avg(days_past_due) AS avg_dpd, count_if(days_past_due >= {cfg.delinquent_dpd}) AS months_delinquent,
                     count_if(days_past_due >= {cfg.default_dpd}) AS months_default, avg({paid}) AS avg_payment_ratio,
                     avg(statement_balance) AS avg_balance, count(period_month) AS months_on_book,
                     sum(CAST(transaction_amount AS BIGINT)) AS total_transactions
              FROM {statements} GROUP BY card_id
            ) b
            JOIN {cards} c ON b.card_id = c.card_id
            JOIN {customers} u ON c.customer_id = u.customer_id""",
        "vw_roll_rate_base": f"""
            SELECT card_id, current_month, current_bucket, next_month, next_bucket, current_balance, next_balance
            FROM (
              SELECT card_id, period_month AS current_month, dpd_bucket AS current_bucket,
                     statement_balance AS current_balance, {later}
              FROM {statements}
            ) WHERE next_month IS NOT NULL""",
        "vw_vintage_base": f"""
            SELECT card_id, cohort_month, period_month,
                   (year(period_month) - year(cohort_month)) * 12 + month(period_month) - month(cohort_month) AS mob,
                   statement_balance, days_past_due, dpd_bucket, credit_limit
            FROM (SELECT *, {first} AS cohort_month FROM {statements})""",
        "vw_early_warning_indicators": f"""
            SELECT *,
                   CASE WHEN days_past_due > prev_dpd AND statement_balance > prev_balance AND paid_amount < prev_paid THEN 'TRIPLE WARNING'
                        WHEN days_past_due > prev_dpd AND statement_balance > prev_balance THEN 'DOUBLE WARNING'
                        WHEN days_past_due > 0 AND prev_dpd = 0 THEN 'NEWLY DELINQUENT'
                        WHEN days_past_due = 0 AND prev_dpd > 0 THEN 'CURED' ELSE 'NORMAL' END AS ewi_flag
            FROM (
              SELECT card_id, period_month, statement_balance, days_past_due, paid_amount, dpd_bucket, {prior}
              FROM {statements}
            ) WHERE prev_balance IS NOT NULL""",
    }
