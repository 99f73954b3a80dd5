"""Common table expressions: the mapped portfolio, its faults and shared joins."""

from __future__ import annotations

from oracle.sql import DEFAULT, LATE, LGD, PAYMENT_TYPE, PAYR, UTIL, EAD, even, mean4, score

PEOPLE = """
people AS (
  SELECT k, r_name AS region, CAST(15000 + 1000 * ((worth + 1000) // 150) AS INT) AS credit_limit, worth, c_nationkey,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'classic' WHEN 'FURNITURE' THEN 'classic' WHEN 'MACHINERY' THEN 'premium'
              WHEN 'HOUSEHOLD' THEN 'platinum' ELSE 'business' END AS product_type,
         CASE WHEN c_acctbal >= 6333 THEN 'high' WHEN c_acctbal >= 2667 THEN 'medium' ELSE 'low' END AS income_band
  FROM (SELECT *, CAST(c_custkey AS BIGINT) AS k, CAST(floor(c_acctbal) AS BIGINT) AS worth FROM customer)
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
)"""

_CUSTOMERS = """
{name} AS (
  SELECT k AS customer_id, region, income_band,
         CAST(abs(worth) % 40 + 25 AS INT) AS age, CAST(c_nationkey % 12 + 1 AS INT) AS tenure_years
  FROM people
)"""
_CARDS = "\n{name} AS (SELECT k AS card_id, k AS customer_id, product_type, credit_limit FROM people)"
_STATEMENTS = """
folded AS (
  SELECT o_custkey, ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1) % 30 AS idx,
         CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS gross,
         CAST(coalesce(sum(CAST(floor(l_extendedprice) AS BIGINT)) FILTER (l_returnflag IS DISTINCT FROM 'R'), 0) AS BIGINT) AS net,
         max(CAST(round(l_discount * 100) AS INT)) AS discount, max(CAST(round(l_tax * 100) AS INT)) AS tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY ALL
),
sized AS (
  SELECT k, idx, credit_limit, gross, net // 3 AS balance, greatest(12 * discount - 4 * tax - 10, 0) AS percent,
         greatest(20 * tax - 10 * discount
                  - CASE WHEN worth < 0 THEN 0 WHEN worth < 2667 THEN 65 WHEN worth < 6333 THEN 90 ELSE 120 END, 0) AS dpd
  FROM people JOIN folded ON o_custkey = k
),
{name} AS (
  SELECT k AS card_id, CAST(make_date(2022 + idx // 12, idx % 12 + 1, 1) AS DATE) AS period_month,
         CAST(balance AS INT) AS statement_balance, CAST(balance // 40 AS INT) AS min_due,
         CAST(balance * percent // 100 AS INT) AS paid_amount, CAST(dpd AS INT) AS days_past_due,
         CASE WHEN dpd = 0 THEN '0' WHEN dpd < 30 THEN '1-29' WHEN dpd < 60 THEN '30-59'
              WHEN dpd < 90 THEN '60-89' ELSE '90+' END AS dpd_bucket,
         credit_limit, CAST(gross // 10 AS INT) AS transaction_amount
  FROM sized
)"""
_WRITEOFFS = """
{name} AS (
  SELECT card_id, amount AS writeoff_amount, CAST(least(amount::BIGINT, amount * paid // (owed * 2)) AS INT) AS recovery_amount,
         CAST(defaulted + INTERVAL 6 MONTH AS DATE) AS writeoff_date
  FROM (SELECT card_id, max(statement_balance) AS amount, CAST(sum(paid_amount) AS BIGINT) AS paid,
               CAST(sum(statement_balance) AS BIGINT) AS owed,
               min(period_month) FILTER (days_past_due >= 90) AS defaulted
        FROM {stmts} GROUP BY card_id HAVING max(days_past_due) >= 95)
  WHERE amount > 0
)"""


def _base(prefix: str) -> str:
    return ",".join(
        [
            PEOPLE,
            _CUSTOMERS.format(name=prefix + "customers"),
            _CARDS.format(name=prefix + "cards"),
            _STATEMENTS.format(name=prefix + "statements"),
            _WRITEOFFS.format(name=prefix + "writeoffs", stmts=prefix + "statements"),
        ]
    )


CLEAN = _base("")

DIRTY = (
    _base("clean_")
    + """,
customers AS (
  SELECT customer_id, CASE WHEN customer_id % 107 <> 0 THEN region END AS region,
         CASE WHEN customer_id % 131 <> 0 THEN income_band END AS income_band, age, tenure_years
  FROM clean_customers
  UNION ALL SELECT * FROM clean_customers WHERE customer_id % 137 = 0
),
cards AS (
  SELECT card_id, CASE WHEN card_id % 101 = 0 THEN customer_id + 1000000 WHEN card_id % 109 <> 0 THEN customer_id END
           AS customer_id, product_type,
         CASE WHEN card_id % 103 = 0 THEN 0 WHEN card_id % 113 <> 0 THEN credit_limit END AS credit_limit
  FROM clean_cards
  UNION ALL SELECT * FROM clean_cards WHERE card_id % 127 = 0
),
statements AS (
  SELECT CASE WHEN z % 199 = 0 THEN card_id + 1000000 ELSE card_id END AS card_id, period_month,
         CASE WHEN z % 211 = 0 THEN -statement_balance - 1 WHEN z % 241 <> 0 THEN statement_balance END
           AS statement_balance, min_due,
         CASE WHEN z % 229 <> 0 THEN paid_amount END AS paid_amount,
         CASE WHEN z % 223 = 0 THEN -5 WHEN z % 233 <> 0 THEN days_past_due END AS days_past_due,
         CASE WHEN z % 227 = 0 THEN '1-29' ELSE dpd_bucket END AS dpd_bucket,
         CASE WHEN z % 239 <> 0 THEN credit_limit END AS credit_limit, transaction_amount
  FROM (SELECT *, card_id * 31 + (year(period_month) - 2022) * 12 + month(period_month) - 1 AS z FROM clean_statements)
  UNION ALL
  SELECT * FROM clean_statements
  WHERE (card_id * 31 + (year(period_month) - 2022) * 12 + month(period_month) - 1) % 251 = 0
),
writeoffs AS (
  SELECT CASE WHEN card_id % 7 = 0 THEN card_id + 1000000 ELSE card_id END AS card_id, amount AS writeoff_amount,
         CASE WHEN card_id % 13 = 0 THEN amount + 1 ELSE recovery_amount END AS recovery_amount, writeoff_date
  FROM (SELECT *, CASE WHEN card_id % 11 = 0 THEN 0 ELSE writeoff_amount END AS amount FROM clean_writeoffs)
)"""
)

# Shared expressions by name; each may use those listed as its needs.
SHARED = {
    "facts": (
        (),
        """facts AS (
  SELECT s.*, ca.customer_id, ca.product_type, ca.credit_limit AS card_limit, cu.region, cu.income_band
  FROM statements s JOIN cards ca ON ca.card_id = s.card_id JOIN customers cu ON cu.customer_id = ca.customer_id
)""",
    ),
    "losses": (
        (),
        """losses AS (
  SELECT w.*, ca.customer_id, ca.product_type, ca.credit_limit, cu.region, cu.income_band
  FROM writeoffs w JOIN cards ca ON ca.card_id = w.card_id JOIN customers cu ON cu.customer_id = ca.customer_id
)""",
    ),
    "moves": (
        (),
        """moves AS (
  SELECT x.card_id, x.period_month AS current_month, x.dpd_bucket AS current_bucket, y.period_month AS next_month,
         y.dpd_bucket AS next_bucket, x.statement_balance AS current_balance, y.statement_balance AS next_balance,
         y.paid_amount AS next_paid
  FROM statements x ASOF JOIN statements y ON x.card_id = y.card_id AND x.period_month < y.period_month
)""",
    ),
    "aged": (
        (),
        """aged AS (
  SELECT s.card_id, cohort_month, period_month, CAST(date_diff('month', cohort_month, period_month) AS INT) AS mob,
         statement_balance, days_past_due, dpd_bucket, credit_limit
  FROM statements s JOIN (SELECT card_id, min(period_month) AS cohort_month FROM statements GROUP BY card_id) f
    ON f.card_id = s.card_id
)""",
    ),
    "latest": ((), "latest AS (SELECT * FROM statements WHERE period_month = (SELECT max(period_month) FROM statements))"),
    "risk": (
        (),
        f"""risk AS (
  SELECT card_id, credit_limit, avg(statement_balance) AS avg_balance, max(days_past_due) AS max_dpd,
         max({EAD}) FILTER (period_month = (SELECT max(period_month) FROM statements)) AS ead,
         CAST(round(CAST({score(f'avg({UTIL})', 'avg(days_past_due)', f'count(*) FILTER ({LATE})', f'avg({PAYR})')}
              AS DECIMAL(28,10)), 4) AS DOUBLE) AS pd,
         (SELECT CAST(round(CAST(avg({LGD}) AS DECIMAL(28,10)), 4) AS DOUBLE) FROM writeoffs) AS lgd
  FROM statements GROUP BY card_id, credit_limit
)""",
    ),
    "feat": (
        (),
        f"""feat AS (
  SELECT *, CASE WHEN utilization <= 0.4e0 AND utilization > -0.001e0 THEN 'Low <40%'
                 WHEN utilization > 0.4e0 AND utilization <= 0.7e0 THEN 'Medium 40-69%'
                 WHEN utilization > 0.7e0 AND utilization <= 0.9e0 THEN 'High 70-89%'
                 WHEN utilization > 0.9e0 THEN 'Critical 90%+' END AS util_band
  FROM (
    SELECT *, {even(UTIL, 4)} AS utilization,
           {even(f'least(greatest(coalesce({PAYR}, 0e0), 0e0), 1e0)', 4)} AS payment_ratio,
           CAST(greatest(statement_balance - paid_amount, 0) AS INT) AS revolving_balance,
           CAST({LATE} AS INT) AS is_delinquent, CAST({DEFAULT} AS INT) AS is_default,
           {PAYMENT_TYPE} AS payment_type
    FROM statements
  )
)""",
    ),
    "wide": (
        ("feat",),
        """wide AS (
  SELECT f.*, ca.customer_id, ca.product_type, cu.region, cu.income_band, cu.age, cu.tenure_years
  FROM feat f LEFT JOIN cards ca ON ca.card_id = f.card_id LEFT JOIN customers cu ON cu.customer_id = ca.customer_id
)""",
    ),
    "scores": (
        ("feat",),
        f"""scores AS (
  SELECT *, {even(score('least(greatest(avg_util, 0e0), 1e0)', 'avg_dpd', 'del_months', 'least(greatest(avg_pay_ratio, 0e0), 1e0)'), 4)} AS pd_score
  FROM (
    SELECT card_id, {mean4('utilization')} AS avg_util, max(utilization) AS max_util, avg(days_past_due) AS avg_dpd,
           max(days_past_due) AS max_dpd, CAST(sum(is_delinquent) AS BIGINT) AS del_months,
           {mean4('payment_ratio')} AS avg_pay_ratio, avg(revolving_balance) AS avg_rev_bal,
           max(is_default) AS default_flag, count(DISTINCT period_month) AS months_on_book
    FROM feat GROUP BY card_id
  )
)""",
    ),
    "el": (
        ("scores",),
        f"""el AS (
  SELECT card_id, pd_score, max_dpd, ead, lgd, {even('pd_score * lgd * ead', 2)} AS expected_loss,
         {even('pd_score * lgd * 1e2', 4)} AS el_rate_pct,
         CASE WHEN max_dpd >= 90 THEN 'Stage 3' WHEN pd_score >= 0.2e0 THEN 'Stage 2' ELSE 'Stage 1' END AS ifrs9_stage
  FROM scores
  LEFT JOIN (SELECT card_id, {even(EAD, 0)} AS ead FROM statements
             WHERE period_month = (SELECT max(period_month) FROM statements)) USING (card_id)
  CROSS JOIN (SELECT {mean4(even(LGD, 4))} AS lgd FROM writeoffs)
)""",
    ),
    "el_wide": (
        ("el",),
        """el_wide AS (
  SELECT el.*, ca.customer_id, ca.product_type, ca.credit_limit, cu.region, cu.income_band, cu.age, cu.tenure_years
  FROM el JOIN cards ca ON ca.card_id = el.card_id JOIN customers cu ON cu.customer_id = ca.customer_id
)""",
    ),
    "segments": (
        ("wide",),
        f"""segments AS (
  SELECT region, income_band, product_type, util_band, count(DISTINCT card_id) AS accounts,
         {mean4('utilization')} AS avg_util, CAST(sum(is_delinquent) AS DOUBLE) / count(*) AS del_rate,
         CAST(sum(is_default) AS DOUBLE) / count(*) AS def_rate, CAST(sum(statement_balance) AS BIGINT) AS exposure
  FROM wide
  WHERE region IS NOT NULL AND income_band IS NOT NULL AND product_type IS NOT NULL AND util_band IS NOT NULL
  GROUP BY ALL
)""",
    ),
    "t1": (
        ("wide",),
        """t1 AS (
  SELECT * FROM wide
  ORDER BY md5('42|' || CAST(card_id AS VARCHAR) || '|' || strftime(period_month, '%Y-%m-%d')), card_id, period_month
  LIMIT (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM wide)
)""",
    ),
}


def compose(body: str, *needs: str, dirty: bool = False) -> str:
    """A complete statement: base tables, the shared expressions needed, the body."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in SHARED[name][0]:
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    parts = [DIRTY if dirty else CLEAN] + [SHARED[n][1] for n in ordered]
    return "WITH" + ",\n".join(parts) + "\n" + body.strip()
