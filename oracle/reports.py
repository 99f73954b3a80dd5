"""SQL for loading, quality checks, views and reports."""

from __future__ import annotations

from oracle.sql import (
    DEFAULT,
    EAD,
    LATE,
    LGD,
    NET,
    PAYMENT_TYPE,
    PAYR,
    SERIOUS,
    UTIL,
    UTIL_BAND,
    big,
    div,
    ladder,
    n_if,
    pct,
    rank,
    rnd,
    score,
    total,
    total_if,
    whole,
)
from oracle.tables import compose

BUCKETS = {"0": "current", "1-29": "1_29", "30-59": "30_59", "60-89": "60_89", "90+": "90_plus"}
TABLES = ("customers", "cards", "statements", "writeoffs")
COLUMNS = {
    "customers": ("customer_id", "region", "income_band", "age", "tenure_years"),
    "cards": ("card_id", "customer_id", "product_type", "credit_limit"),
    "statements": (
        "card_id",
        "period_month",
        "statement_balance",
        "min_due",
        "paid_amount",
        "days_past_due",
        "dpd_bucket",
        "credit_limit",
        "transaction_amount",
    ),
    "writeoffs": ("card_id", "writeoff_amount", "recovery_amount", "writeoff_date"),
}


def load() -> dict[str, str]:
    counts = " UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS rows FROM {t}" for t in TABLES)
    nulls = " UNION ALL ".join(
        f"SELECT '{t}' AS tbl, {' + '.join(f'count(*) - count({c})' for c in COLUMNS[t])} AS null_cells FROM {t}"
        for t in TABLES
    )
    return {
        "row_counts": compose(counts),
        "date_range": compose(
            "SELECT min(period_month) AS min_month, max(period_month) AS max_month FROM statements"
        ),
        "null_totals": compose(nulls, dirty=True),
    }


def quality() -> dict[str, str]:
    def nulls(table: str, columns: dict[str, str]) -> str:
        cells = ", ".join(f"{n_if(f'{c} IS NULL')} AS null_{name}" for name, c in columns.items())
        return f"SELECT '{table} - null check' AS check_name, {cells} FROM {table}"

    def repeated(table: str, keys: str) -> str:
        return f"SELECT {keys}, count(*) AS cnt FROM {table} GROUP BY ALL HAVING count(*) > 1"

    def issue(name: str, table: str, condition: str) -> str:
        return f"SELECT '{name}' AS issue, {n_if(condition)} AS count FROM {table}"

    def orphans(name: str, child: str, parent: str, key: str) -> str:
        found = f"EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{key})"
        return f"SELECT '{name}' AS issue, count(*) AS count FROM {child} c WHERE NOT {found}"

    mismatch = " OR ".join(
        f"(days_past_due BETWEEN {lo} AND {hi} AND dpd_bucket <> '{b}')"
        for b, lo, hi in (("0", 0, 0), ("1-29", 1, 29), ("30-59", 30, 59), ("60-89", 60, 89))
    )
    mismatch += " OR (days_past_due >= 90 AND dpd_bucket <> '90+')"
    cell_checks = {
        "customers": ["customer_id", "region", "income_band"],
        "cards": ["card_id", "customer_id", "credit_limit"],
        "statements": ["statement_balance", "paid_amount", "days_past_due", "credit_limit"],
    }
    row_checks = [(t, f"null_{c}", f"{c} IS NULL") for t, columns in cell_checks.items() for c in columns]
    row_checks += [
        ("cards", "bad_credit_limit", "credit_limit <= 0"),
        ("statements", "negative_balance", "statement_balance < 0"),
        ("statements", "negative_dpd", "days_past_due < 0"),
        ("statements", "overpayment", "paid_amount > statement_balance"),
        ("statements", "over_limit", "statement_balance > credit_limit"),
        ("statements", "dpd_bucket_mismatch", mismatch),
        ("writeoffs", "negative_writeoff", "writeoff_amount <= 0"),
        ("writeoffs", "recovery_exceeds_writeoff", "recovery_amount > writeoff_amount"),
    ]
    battery = " UNION ALL ".join(
        f"SELECT '{t}' AS tbl, '{name}' AS issue, {n_if(condition)} AS count FROM {t}" for t, name, condition in row_checks
    )
    bodies = {
        "dq_null_customers": nulls(
            "customers", {"customer_id": "customer_id", "region": "region", "income_band": "income_band"}
        ),
        "dq_null_cards": nulls(
            "cards", {"card_id": "card_id", "customer_id": "customer_id", "credit_limit": "credit_limit"}
        ),
        "dq_null_statements": nulls(
            "statements",
            {"balance": "statement_balance", "paid": "paid_amount", "dpd": "days_past_due", "limit": "credit_limit"},
        ),
        "dq_dup_customers": repeated("customers", "customer_id"),
        "dq_dup_cards": repeated("cards", "card_id"),
        "dq_dup_statements": repeated("statements", "card_id, period_month"),
        "dq_negative_balance": issue("negative_balance", "statements", "statement_balance < 0"),
        "dq_negative_dpd": issue("negative_dpd", "statements", "days_past_due < 0"),
        "dq_overpayment": issue("overpayment", "statements", "paid_amount > statement_balance"),
        "dq_bad_credit_limit": issue("bad_credit_limit", "cards", "credit_limit <= 0"),
        "dq_over_limit": issue("over_limit", "statements", "statement_balance > credit_limit"),
        "dq_bucket_mismatch": issue("dpd_bucket_mismatch", "statements", mismatch),
        "dq_orphan_cards": orphans("orphan_cards", "cards", "customers", "customer_id"),
        "dq_orphan_statements": orphans("orphan_statements", "statements", "cards", "card_id"),
        "dq_orphan_writeoffs": orphans("orphan_writeoffs", "writeoffs", "cards", "card_id"),
        "dq_battery": battery,
        "profile_customers": f"""
            SELECT region, income_band, count(*) AS customers,
                   {pct('count(*)', '(SELECT count(*) FROM customers)')} AS pct
            FROM customers GROUP BY ALL""",
        "profile_products": f"""
            SELECT product_type, count(*) AS cards, {rnd('avg(credit_limit)', 0)} AS avg_limit,
                   min(credit_limit) AS min_limit, max(credit_limit) AS max_limit
            FROM cards GROUP BY ALL""",
        "profile_dpd_bucket": f"""
            SELECT dpd_bucket, count(*) AS account_months,
                   {pct('count(*)', '(SELECT count(*) FROM statements)')} AS pct,
                   {total('statement_balance')} AS total_exposure
            FROM statements GROUP BY ALL""",
        "monthly_completeness": """
            SELECT period_month, count(*) AS statements, count(DISTINCT card_id) AS unique_cards
            FROM statements GROUP BY ALL""",
        "dq_negative_writeoff": issue("negative_writeoff", "writeoffs", "writeoff_amount <= 0"),
        "dq_recovery_exceeds": issue(
            "recovery_exceeds_writeoff", "writeoffs", "recovery_amount > writeoff_amount"
        ),
        "dq_lgd_range": f"""
            SELECT {rnd(f'min({LGD})', 10)} AS min_lgd, {rnd(f'max({LGD})', 10)} AS max_lgd,
                   {rnd(f'avg({LGD})', 10)} AS avg_lgd
            FROM writeoffs""",
    }
    return {k: compose(v, dirty=True) for k, v in bodies.items()}


def views() -> dict[str, str]:
    lag = lambda c: f"lag({c}) OVER (PARTITION BY card_id ORDER BY period_month)"
    averages = ("avg_utilization", "max_utilization", "avg_dpd", "avg_payment_ratio", "avg_balance")
    return {
        "credit_utilization": compose(
            f"""
            SELECT card_id, customer_id, period_month, statement_balance, credit_limit,
                   {rnd(UTIL, 4)} AS utilization_ratio, {UTIL_BAND} AS utilization_band
            FROM facts""",
            "facts",
        ),
        "payment_behavior": compose(f"""
            SELECT card_id, period_month, statement_balance, min_due, paid_amount, days_past_due, dpd_bucket,
                   {rnd(PAYR, 4)} AS payment_ratio, {PAYMENT_TYPE} AS payment_type,
                   statement_balance - paid_amount AS revolving_balance
            FROM statements"""),
        "customer_risk_profile": compose(
            f"""
            SELECT card_id, customer_id, region, income_band, product_type, card_limit AS credit_limit,
                   {', '.join(f'{rnd(c, 6)} AS {c}' for c in averages)},
                   max_dpd_ever, months_delinquent, months_default, months_on_book, total_transactions,
                   CASE WHEN avg_payment_ratio >= 0.95e0 THEN 'Transactor'
                        WHEN avg_payment_ratio >= 0.5e0 THEN 'Revolving' ELSE 'Distressed' END AS customer_segment,
                   {rnd('40e0 * least(avg_utilization, 1e0) + 40e0 * least(avg_dpd / 90e0, 1e0) + 20e0 * (1e0 - least(avg_payment_ratio, 1e0))', 2)} AS risk_score
            FROM (
              SELECT card_id, customer_id, region, income_band, product_type, card_limit,
                     avg({UTIL}) AS avg_utilization, max({UTIL}) AS max_utilization,
                     max(days_past_due) AS max_dpd_ever, avg(days_past_due) AS avg_dpd,
                     {n_if(LATE)} AS months_delinquent, {n_if(DEFAULT)} AS months_default,
                     avg({PAYR}) AS avg_payment_ratio, avg(statement_balance) AS avg_balance,
                     count(DISTINCT period_month) AS months_on_book, {total('transaction_amount')} AS total_transactions
              FROM facts GROUP BY ALL
            )""",
            "facts",
        ),
        "roll_rate_base": compose("SELECT * EXCLUDE (next_paid) FROM moves", "moves"),
        "vintage_base": compose("SELECT * FROM aged", "aged"),
        "early_warning": compose(f"""
            SELECT *, CASE
                WHEN days_past_due > prev_dpd AND statement_balance > prev_balance
                  THEN CASE WHEN paid_amount < prev_paid THEN 'TRIPLE WARNING' ELSE 'DOUBLE WARNING' END
                WHEN prev_dpd = 0 AND days_past_due > 0 THEN 'NEWLY DELINQUENT'
                WHEN prev_dpd > 0 AND days_past_due = 0 THEN 'CURED'
                ELSE 'NORMAL' END AS ewi_flag
            FROM (
              SELECT card_id, period_month, statement_balance, days_past_due, paid_amount, dpd_bucket,
                     {lag('statement_balance')} AS prev_balance, {lag('days_past_due')} AS prev_dpd,
                     {lag('paid_amount')} AS prev_paid, {lag('dpd_bucket')} AS prev_bucket
              FROM statements
            ) WHERE prev_balance IS NOT NULL"""),
    }


RATES = f"{pct(n_if(LATE), 'count(*)')} AS del_rate_pct, {pct(n_if(DEFAULT), 'count(*)')} AS default_rate_pct"
CARDS_SEEN = "count(DISTINCT card_id)"
EXPOSURE = total("statement_balance")
MEAN_UTIL = rnd(f"avg({UTIL})", 4)


def kpis() -> dict[str, str]:
    return {
        "kpi_portfolio": compose(
            f"""
            SELECT count(DISTINCT customer_id) AS total_customers, {CARDS_SEEN} AS total_accounts,
                   {EXPOSURE} AS total_exposure, {rnd('avg(statement_balance)', 2)} AS avg_balance,
                   {MEAN_UTIL} AS avg_utilization, {n_if(LATE)} AS delinquent_accounts,
                   {n_if(DEFAULT)} AS default_accounts, {pct(n_if(LATE), 'count(*)')} AS delinquency_rate_pct,
                   {pct(n_if(DEFAULT), 'count(*)')} AS default_rate_pct
            FROM facts""",
            "facts",
        ),
        "kpi_dpd_bucket": compose(f"""
            SELECT dpd_bucket, count(*) AS account_months, {CARDS_SEEN} AS unique_accounts,
                   {EXPOSURE} AS total_exposure,
                   {pct('count(*)', '(SELECT count(*) FROM statements)')} AS pct_of_portfolio
            FROM statements GROUP BY ALL"""),
        "kpi_util_band": compose(f"""
            SELECT {UTIL_BAND} AS util_band, count(*) AS account_months, {CARDS_SEEN} AS unique_accounts,
                   {EXPOSURE} AS exposure, {rnd('avg(days_past_due)', 2)} AS avg_dpd
            FROM statements GROUP BY ALL"""),
        "kpi_payment_type": compose(f"""
            SELECT {PAYMENT_TYPE} AS payment_type, count(*) AS occurrences,
                   {pct('count(*)', '(SELECT count(*) FROM statements)')} AS pct,
                   {total('statement_balance - paid_amount')} AS revolving_balance,
                   {rnd('avg(days_past_due)', 2)} AS avg_dpd
            FROM statements GROUP BY ALL"""),
        "kpi_region": compose(
            f"""
            SELECT region, {CARDS_SEEN} AS accounts, {EXPOSURE} AS total_exposure, {MEAN_UTIL} AS avg_utilization,
                   {RATES}, {rnd(f'avg({PAYR})', 4)} AS avg_payment_ratio
            FROM facts GROUP BY ALL""",
            "facts",
        ),
        "kpi_income": compose(
            f"""
            SELECT income_band, {CARDS_SEEN} AS accounts, {rnd('avg(card_limit)', 0)} AS avg_limit,
                   {rnd('avg(statement_balance)', 0)} AS avg_balance, {MEAN_UTIL} AS avg_utilization, {RATES}
            FROM facts GROUP BY ALL""",
            "facts",
        ),
        "kpi_product": compose(
            f"""
            SELECT product_type, {CARDS_SEEN} AS accounts, {rnd('avg(card_limit)', 0)} AS avg_limit,
                   {EXPOSURE} AS total_exposure, {MEAN_UTIL} AS avg_utilization, {RATES}
            FROM facts GROUP BY ALL""",
            "facts",
        ),
        "kpi_monthly_trend": compose(f"""
            SELECT period_month, count(*) AS total_accounts, {n_if(LATE)} AS dpd_30plus,
                   {n_if(SERIOUS)} AS dpd_60plus, {n_if(DEFAULT)} AS dpd_90plus, {EXPOSURE} AS total_exposure,
                   {total_if(LATE, 'statement_balance')} AS at_risk_exposure,
                   {pct(n_if(LATE), 'count(*)')} AS del_rate_pct
            FROM statements GROUP BY ALL"""),
        "report_pack": compose(f"""
            SELECT CASE WHEN grouping(payment_type) = 0 THEN 'payment' WHEN grouping(period_month) = 1 THEN 'bucket'
                        WHEN grouping(dpd_bucket) = 1 THEN 'month' ELSE 'month and bucket' END AS report,
                   period_month, dpd_bucket, payment_type, count(*) AS statements, {n_if(LATE)} AS dpd_30plus,
                   {n_if(SERIOUS)} AS dpd_60plus, {n_if(DEFAULT)} AS dpd_90plus, {total('statement_balance')} AS balance,
                   {total_if(LATE, 'statement_balance')} AS late_balance, {total('statement_balance - paid_amount')} AS revolving,
                   {total('days_past_due')} AS dpd, count(days_past_due) AS with_dpd
            FROM (SELECT *, {PAYMENT_TYPE} AS payment_type FROM statements)
            GROUP BY GROUPING SETS ((period_month), (dpd_bucket), (payment_type), (period_month, dpd_bucket))"""),
        "top_risk_accounts": compose(
            f"""
            SELECT card_id, region, income_band, product_type, card_limit AS credit_limit, statement_balance,
                   {rnd(UTIL, 4)} AS utilization, days_past_due, dpd_bucket, {rnd(PAYR, 4)} AS payment_ratio
            FROM facts WHERE period_month = (SELECT max(period_month) FROM statements)
            ORDER BY days_past_due DESC, statement_balance DESC, card_id LIMIT 50""",
            "facts",
        ),
    }


def delinquency() -> dict[str, str]:
    return {
        "delinquency_mom": compose(f"""
            SELECT *, {rnd('del_rate_pct - lag(del_rate_pct) OVER (ORDER BY period_month)', 2)} AS mom_change_pct
            FROM (
              SELECT period_month, count(*) AS total, {n_if(LATE)} AS delinquent, {EXPOSURE} AS exposure,
                     {pct(n_if(LATE), 'count(*)')} AS del_rate_pct, {pct(n_if(SERIOUS), 'count(*)')} AS dpd60_rate_pct,
                     {pct(n_if(DEFAULT), 'count(*)')} AS dpd90_rate_pct
              FROM statements GROUP BY ALL
            )"""),
        "cure_rate": compose(
            f"""
            SELECT current_bucket, count(*) AS total_transitions, {n_if("next_bucket = '0'")} AS cured,
                   {pct(n_if("next_bucket = '0'"), 'count(*)')} AS cure_rate_pct,
                   {pct(n_if('next_bucket > current_bucket'), 'count(*)')} AS worsening_rate_pct
            FROM moves WHERE current_bucket <> '0' GROUP BY ALL""",
            "moves",
        ),
        "ewi_summary": compose(f"""
            SELECT ewi_flag, count(*) AS occurrences, {CARDS_SEEN} AS unique_accounts,
                   {pct('count(*)', 'sum(count(*)) OVER ()')} AS pct,
                   {rnd('avg(days_past_due)', 2)} AS avg_current_dpd
            FROM (
              SELECT x.card_id, x.days_past_due, CASE
                  WHEN x.days_past_due > y.days_past_due AND x.statement_balance > y.statement_balance
                    THEN if(x.paid_amount < y.paid_amount, 'TRIPLE WARNING', 'DOUBLE WARNING')
                  WHEN x.days_past_due > 0 AND y.days_past_due = 0 THEN 'NEWLY DELINQUENT'
                  WHEN x.days_past_due = 0 AND y.days_past_due > 0 THEN 'CURED'
                  ELSE 'NORMAL' END AS ewi_flag
              FROM statements x ASOF JOIN statements y ON x.card_id = y.card_id AND x.period_month > y.period_month
            ) GROUP BY ewi_flag"""),
        "delinquency_streaks": compose(f"""
            SELECT card_id, max(n) AS max_consecutive_delinquent_months
            FROM (
              SELECT card_id, count(*) AS n
              FROM (
                SELECT card_id, late, seq - row_number() OVER (PARTITION BY card_id, late ORDER BY seq) AS island
                FROM (SELECT card_id, {LATE} AS late,
                             row_number() OVER (PARTITION BY card_id ORDER BY period_month) AS seq FROM statements)
              ) WHERE late GROUP BY card_id, island
            ) GROUP BY card_id HAVING max(n) >= 3
            ORDER BY max_consecutive_delinquent_months DESC, card_id LIMIT 100"""),
        "balance_migration": compose(f"""
            SELECT *, b_30_59 + b_60_89 + b_90_plus AS total_delinquent_bal,
                   {pct('b_30_59 + b_60_89 + b_90_plus', 'current_bal + b_1_29 + b_30_59 + b_60_89 + b_90_plus')}
                     AS delinquent_bal_pct
            FROM (
              SELECT period_month, {', '.join(
                  f"{total_if(f'''dpd_bucket = '{b}' ''', 'statement_balance')} AS "
                  + ('current_bal' if b == '0' else f'b_{s}') for b, s in BUCKETS.items())}
              FROM statements GROUP BY period_month
            )"""),
        "first_payment_default": compose(f"""
            SELECT card_id, max(days_past_due) AS max_early_dpd, {n_if(LATE)} AS early_delinquent_months
            FROM (SELECT * FROM statements
                  QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY period_month) < 4)
            GROUP BY card_id HAVING {n_if(LATE)} > 0
            ORDER BY max_early_dpd DESC, card_id LIMIT 200"""),
    }


def book() -> dict[str, str]:
    canonical = "CAST(util * 40e0 + dpd / 90e0 * 40e0 + (1e0 - paid) * 20e0 AS DECIMAL(28,10))"
    maxed = f"{UTIL} > 0.9e0"
    group = ladder(
        "days_past_due",
        "<=",
        [("29", "1-29 DPD"), ("59", "30-59 DPD"), ("89", "60-89 DPD")],
        "90+ DPD",
    ).replace("CASE", "CASE WHEN days_past_due = 0 THEN 'Current'", 1)
    return {
        "cumulative_exposure": compose(f"""
            SELECT period_month, monthly_exposure,
                   CAST((SELECT sum(statement_balance) FROM statements s WHERE s.period_month <= m.period_month) AS BIGINT)
                     AS cumulative_exposure
            FROM (SELECT period_month, {EXPOSURE} AS monthly_exposure FROM statements GROUP BY ALL) m"""),
        "delinquency_bps": compose(f"""
            SELECT period_month, del_rate, lag(del_rate) OVER w AS prev_rate,
                   {rnd('(del_rate - lag(del_rate) OVER w) * 1e2', 2)} AS change_bps
            FROM (SELECT period_month, {pct(n_if(LATE), 'count(*)', 4)} AS del_rate FROM statements GROUP BY ALL)
            WINDOW w AS (ORDER BY period_month)"""),
        "rolling_util_3m": compose(f"""
            SELECT card_id, period_month, {rnd('u', 4)} AS utilization,
                   {rnd('avg(u) OVER (PARTITION BY card_id ORDER BY period_month ROWS 2 PRECEDING)', 4)} AS util_3mo_avg
            FROM (SELECT *, {UTIL} AS u FROM statements)"""),
        "rfm_scoring": compose(f"""
            SELECT card_id, last_delinquent_month, frequency, {rnd('r', 2)} AS avg_revolving_bal,
                   CAST(ntile(5) OVER (ORDER BY frequency DESC, card_id) AS INT) AS freq_quintile,
                   CAST(ntile(5) OVER (ORDER BY r DESC, card_id) AS INT) AS monetary_quintile
            FROM (
              SELECT card_id, max(period_month) FILTER ({LATE}) AS last_delinquent_month, {n_if(LATE)} AS frequency,
                     {div('sum(statement_balance - paid_amount)', 'count(*)')} AS r
              FROM statements GROUP BY card_id
            )"""),
        "payment_gap": compose(
            f"""
            SELECT region, income_band, count(*) AS statements,
                   {rnd('avg(greatest(min_due - paid_amount, 0))', 2)} AS avg_payment_gap,
                   {n_if('paid_amount < min_due')} AS below_min_count,
                   {pct(n_if('paid_amount < min_due'), 'count(*)')} AS below_min_pct
            FROM facts GROUP BY ALL""",
            "facts",
        ),
        "stress_test": compose(f"""
            SELECT period_month, {EXPOSURE} AS current_exposure,
                   {rnd('CAST(sum(statement_balance) AS DOUBLE) * 1.25e0', 2)} AS stressed_exposure_25pct,
                   {pct(n_if(LATE), 'count(*)')} AS current_del_rate,
                   {rnd(f'CAST({n_if(LATE)} AS DOUBLE) * 1e2 / count(*) * 1.3e0', 2)} AS stressed_del_rate
            FROM statements GROUP BY ALL"""),
        "concentration_top100": compose(
            f"""
            SELECT customer_id, region, product_type, {EXPOSURE} AS total_balance, max(days_past_due) AS max_dpd,
                   {pct('sum(statement_balance)', '(SELECT sum(statement_balance) FROM statements)', 6)}
                     AS pct_of_portfolio
            FROM facts GROUP BY ALL ORDER BY total_balance DESC, customer_id, product_type LIMIT 100""",
            "facts",
        ),
        "cohort_retention": compose(
            f"""
            SELECT cohort_month, period_month, initial_size, {CARDS_SEEN} AS active,
                   {pct(CARDS_SEEN, 'initial_size')} AS retention_pct
            FROM aged JOIN (SELECT cohort_month, {CARDS_SEEN} AS initial_size FROM aged GROUP BY ALL)
              USING (cohort_month)
            GROUP BY cohort_month, period_month, initial_size""",
            "aged",
        ),
        "collections_efficiency": compose(f"""
            SELECT x.period_month, count(*) AS delinquent_accounts, {total('x.statement_balance')} AS at_risk_balance,
                   {total('y.paid_amount')} AS recovered,
                   {pct('sum(y.paid_amount)', 'sum(x.statement_balance)')} AS recovery_rate_pct
            FROM (SELECT * FROM statements WHERE {LATE}) x
            ASOF LEFT JOIN statements y ON x.card_id = y.card_id AND x.period_month < y.period_month
            GROUP BY x.period_month"""),
        "risk_decile": compose(f"""
            SELECT card_id, credit_limit, {rnd('util', 4)} AS avg_util, {rnd('dpd', 2)} AS avg_dpd,
                   {rnd('payr', 4)} AS avg_pay_ratio, {rnd(canonical, 2)} AS risk_score,
                   CAST(ntile(10) OVER (ORDER BY {canonical} DESC, card_id, credit_limit) AS INT) AS risk_decile
            FROM (
              SELECT card_id, credit_limit, avg({UTIL}) AS util, avg(days_past_due) AS dpd, avg({PAYR}) AS payr,
                     avg(least({PAYR}, 1e0)) AS paid
              FROM statements GROUP BY ALL
            )"""),
        "lgd_proxy": compose(
            f"""
            SELECT product_type, income_band, {CARDS_SEEN} AS accounts, {EXPOSURE} AS total_exposure,
                   {total_if(SERIOUS, 'statement_balance')} AS at_risk_exposure,
                   {pct(total_if(SERIOUS, 'statement_balance'), 'sum(statement_balance)')} AS lgd_proxy_pct
            FROM facts GROUP BY ALL""",
            "facts",
        ),
        "writeoffs_product_region": compose(
            f"""
            SELECT product_type, region, count(*) AS writeoffs, {total('writeoff_amount')} AS total_written_off,
                   {total('recovery_amount')} AS total_recovered, {rnd(f'avg({LGD})', 4)} AS avg_lgd,
                   {total(NET)} AS net_loss
            FROM losses GROUP BY ALL""",
            "losses",
        ),
        "limit_adequacy": compose(
            f"""
            SELECT income_band, product_type, {rnd('avg(card_limit)', 0)} AS avg_limit,
                   {rnd('avg(statement_balance)', 0)} AS avg_balance, {MEAN_UTIL} AS avg_util,
                   {n_if(maxed)} AS maxed_accounts, {pct(n_if(maxed), 'count(*)')} AS pct_maxed
            FROM facts GROUP BY ALL""",
            "facts",
        ),
        "migration_pivot_counts": compose(
            f"""
            SELECT current_bucket, {', '.join(f"{n_if(f'''next_bucket = '{b}' ''')} AS to_{s}" for b, s in BUCKETS.items())},
                   count(*) AS total
            FROM moves GROUP BY current_bucket""",
            "moves",
        ),
        "activity_vs_delinquency": compose(f"""
            SELECT {group} AS dpd_group, count(*) AS account_months,
                   {rnd('avg(transaction_amount)', 2)} AS avg_transaction,
                   {rnd('avg(statement_balance)', 2)} AS avg_balance,
                   {rnd(f"avg({div('transaction_amount', 'statement_balance')})", 4)} AS tx_to_balance_ratio
            FROM statements GROUP BY ALL"""),
    }


def default_probability() -> dict[str, str]:
    ever = f"count(DISTINCT card_id) FILTER ({DEFAULT})"

    def segment(key: str, more: str = "") -> str:
        return compose(
            f"""
            SELECT {key}, {CARDS_SEEN} AS accounts, {ever} AS defaults, {pct(ever, CARDS_SEEN, 4)} AS pd_pct{more}
            FROM facts GROUP BY {key}""",
            "facts",
        )

    rate = f"CAST({n_if(DEFAULT)} AS DOUBLE) * 1e2 / count(*)"
    return {
        "pd_portfolio": compose(f"""
            SELECT {ever} AS defaulted_accounts, {CARDS_SEEN} AS total_accounts, {pct(ever, CARDS_SEEN, 4)} AS pd_pct
            FROM statements"""),
        "pd_monthly": compose(f"""
            SELECT period_month, n AS total_accounts, d AS defaults, {rnd('rate', 4)} AS pd_pct,
                   {rnd('avg(rate) OVER (ORDER BY period_month ROWS 2 PRECEDING)', 4)} AS pd_3mo_avg
            FROM (SELECT period_month, count(*) AS n, {n_if(DEFAULT)} AS d, {rate} AS rate
                  FROM statements GROUP BY period_month)"""),
        "pd_region": segment("region"),
        "pd_income": segment("income_band", f", {rnd('avg(card_limit)', 0)} AS avg_limit"),
        "pd_product": segment("product_type"),
        "pd_util_band": compose(f"""
            SELECT {UTIL_BAND} AS utilization_band, count(*) AS account_months, {n_if(DEFAULT)} AS defaults,
                   {pct(n_if(DEFAULT), 'count(*)', 4)} AS pd_pct
            FROM statements GROUP BY ALL"""),
        "pd_mob_curve": compose(f"""
            SELECT CAST(mob AS INT) AS mob, count(*) AS accounts, {n_if(DEFAULT)} AS defaults,
                   {pct(n_if(DEFAULT), 'count(*)', 4)} AS pd_pct
            FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY period_month) AS mob FROM statements)
            GROUP BY ALL"""),
        "pd_score_12m": compose(f"""
            SELECT *, CASE WHEN pd_score_12m >= 0.6e0 THEN 'Stage 3 (Default)'
                           WHEN pd_score_12m >= 0.2e0 THEN 'Stage 2 (Significant Increase)'
                           ELSE 'Stage 1 (Performing)' END AS ifrs9_stage
            FROM (
              SELECT *, {rnd(score('avg_util', 'avg_dpd', 'del_months', 'avg_pay_ratio'), 4)} AS pd_score_12m
              FROM (
                SELECT card_id, {rnd(f'avg({UTIL})', 4)} AS avg_util, {rnd('avg(days_past_due)', 4)} AS avg_dpd,
                       max(days_past_due) AS max_dpd, {n_if(LATE)} AS del_months,
                       {rnd(f'avg({PAYR})', 4)} AS avg_pay_ratio, count(DISTINCT period_month) AS months_on_book
                FROM statements GROUP BY card_id, credit_limit
              )
            )"""),
    }


def loss_given_default() -> dict[str, str]:
    sums = f"{total('writeoff_amount')} AS total_written_off, {total('recovery_amount')} AS total_recovered"
    means = (
        f"{rnd(f'avg({LGD})', 4)} AS avg_lgd, {pct('sum(recovery_amount)', 'sum(writeoff_amount)')} AS recovery_rate_pct"
    )
    by = lambda key: compose(
        f"SELECT {key}, count(*) AS writeoffs, {sums}, {means} FROM losses GROUP BY {key}", "losses"
    )
    band = ladder(
        LGD,
        "<",
        [("0.2e0", "0-20% (Low Loss)"), ("0.4e0", "20-40%"), ("0.6e0", "40-60%"), ("0.8e0", "60-80%")],
        "80-100% (High Loss)",
    )
    limit = ladder(
        "credit_limit",
        "<",
        [("50000", "Low (<50K)"), ("150000", "Medium (50K-150K)"), ("400000", "High (150K-400K)")],
        "Premium (400K+)",
    )
    return {
        "lgd_portfolio": compose(f"""
            SELECT count(*) AS total_writeoffs, {sums}, {total(NET)} AS total_net_loss,
                   {pct(f'sum({NET})', 'sum(writeoff_amount)')} AS portfolio_lgd_pct, {means}
            FROM writeoffs"""),
        "lgd_product": compose(
            f"""
            SELECT product_type, count(*) AS writeoffs, {sums}, {total(NET)} AS net_loss, {means}
            FROM losses GROUP BY product_type""",
            "losses",
        ),
        "lgd_income": by("income_band"),
        "lgd_region": by("region"),
        "lgd_monthly": compose(f"""
            SELECT CAST(date_trunc('month', writeoff_date) AS DATE) AS writeoff_month, count(*) AS writeoffs,
                   {sums}, {means}
            FROM writeoffs GROUP BY ALL"""),
        "lgd_histogram": compose(f"""
            SELECT {band} AS lgd_band, count(*) AS writeoffs, {total('writeoff_amount')} AS total_exposure,
                   {total(NET)} AS net_loss, {pct('count(*)', '(SELECT count(*) FROM writeoffs)')} AS pct_of_writeoffs
            FROM writeoffs GROUP BY ALL"""),
        "lgd_account_detail": compose(
            f"""
            SELECT card_id, product_type, region, income_band, credit_limit, writeoff_amount, recovery_amount,
                   {NET} AS net_loss, {rnd(LGD, 4)} AS lgd,
                   {rnd(div('recovery_amount', 'writeoff_amount'), 4)} AS recovery_rate, writeoff_date
            FROM losses""",
            "losses",
        ),
        "lgd_limit_band": compose(
            f"""
            SELECT {limit} AS limit_band, count(*) AS writeoffs, {rnd('avg(credit_limit)', 0)} AS avg_limit,
                   {rnd('avg(writeoff_amount)', 0)} AS avg_writeoff, {rnd(f'avg({LGD})', 4)} AS avg_lgd
            FROM losses GROUP BY ALL""",
            "losses",
        ),
    }


def exposure() -> dict[str, str]:
    unused = "credit_limit - statement_balance"
    last = "period_month = (SELECT max(period_month) FROM statements)"
    whole = f"sum({rnd(EAD, 0)})"
    scenarios = " UNION ALL ".join(
        f"SELECT '{label}' AS ccf_scenario, {rnd(f'CAST(sum({amount}) AS DOUBLE)', 2)} AS portfolio_ead, "
        f"CAST({ccf} AS DOUBLE) AS ccf_assumption FROM latest"
        for ccf, label, amount in (
            ("0.00", "CCF = 0%  (Balance Only)", "statement_balance"),
            ("0.25", "CCF = 25%", f"statement_balance + 0.25e0 * ({unused})"),
            ("0.50", "CCF = 50%", f"statement_balance + 0.5e0 * ({unused})"),
            ("0.75", "CCF = 75% (Basel III)", f"statement_balance + 0.75e0 * ({unused})"),
            ("1.00", "CCF = 100% (Full Limit)", "credit_limit"),
        )
    )
    return {
        "ead_account": compose(
            f"""
            SELECT card_id, customer_id, product_type, credit_limit, statement_balance AS current_balance,
                   {unused} AS unused_limit, {rnd(UTIL, 4)} AS current_utilization,
                   statement_balance + {rnd(f'0.75e0 * ({unused})', 0)} AS ead_ccf_75, credit_limit AS ead_ccf_100,
                   statement_balance + {rnd(f'0.5e0 * ({unused})', 0)} AS ead_ccf_50
            FROM facts WHERE {last}""",
            "facts",
        ),
        "ead_portfolio": compose(
            f"""
            SELECT {CARDS_SEEN} AS total_accounts, {total('statement_balance')} AS total_current_balance,
                   {total(unused)} AS total_unused_limit, {rnd(f'sum({EAD})', 2)} AS portfolio_ead_75,
                   {total('credit_limit')} AS portfolio_ead_100,
                   {rnd(div(f'sum({EAD})', 'sum(statement_balance)'), 4)} AS ead_uplift_factor
            FROM latest""",
            "latest",
        ),
        "ead_product": compose(
            f"""
            SELECT product_type, {CARDS_SEEN} AS accounts, {rnd('avg(credit_limit)', 0)} AS avg_credit_limit,
                   {rnd('avg(statement_balance)', 0)} AS avg_current_balance, {MEAN_UTIL} AS avg_utilization,
                   {rnd(f'avg({EAD})', 0)} AS avg_ead, {whole} AS total_ead
            FROM facts WHERE {last} GROUP BY ALL""",
            "facts",
        ),
        "ead_income": compose(
            f"""
            SELECT income_band, {CARDS_SEEN} AS accounts, {rnd('avg(card_limit)', 0)} AS avg_limit,
                   {rnd(f'avg({EAD})', 0)} AS avg_ead, {whole} AS total_ead, {total(unused)} AS total_unused_limit,
                   {pct(f'sum({unused})', 'sum(credit_limit)')} AS unused_limit_pct
            FROM facts WHERE {last} GROUP BY ALL""",
            "facts",
        ),
        "ead_region": compose(
            f"""
            SELECT region, {CARDS_SEEN} AS accounts, {EXPOSURE} AS current_exposure, {whole} AS total_ead,
                   {total('credit_limit')} AS max_possible_ead, {pct(whole, 'sum(credit_limit)')} AS ead_as_pct_of_max
            FROM facts WHERE {last} GROUP BY ALL""",
            "facts",
        ),
        "ead_ccf_sensitivity": compose(scenarios, "latest"),
        "ead_monthly": compose(f"""
            SELECT period_month, {EXPOSURE} AS current_balance, {total('credit_limit')} AS total_credit_limit,
                   {rnd(f'sum({EAD})', 2)} AS ead_75_ccf, {pct(f'sum({EAD})', 'sum(credit_limit)')} AS ead_utilization_pct
            FROM statements GROUP BY ALL"""),
    }


def expected_loss() -> dict[str, str]:
    loss = "pd * lgd * ead"
    stage = lambda a, b, c: (
        f"CASE WHEN max_dpd >= 90 THEN '{a}' WHEN pd >= 0.2e0 THEN '{b}' ELSE '{c}' END AS ifrs9_stage"
    )
    return {
        "expected_loss_account": compose(
            f"""
            SELECT card_id, ca.customer_id, product_type, region, income_band, risk.credit_limit,
                   {rnd('avg_balance', 0)} AS avg_balance, {rnd('ead', 0)} AS ead, pd, lgd,
                   {rnd(loss, 2)} AS expected_loss, {rnd('pd * lgd * 1e2', 4)} AS el_rate_pct, max_dpd,
                   {stage('Stage 3 (Credit-Impaired)', 'Stage 2 (Significant Increase in CR)', 'Stage 1 (Performing)')}
            FROM risk JOIN cards ca USING (card_id) JOIN customers USING (customer_id)""",
            "risk",
        ),
        "expected_loss_portfolio": compose(
            f"""
            SELECT sum(ead) AS total_ead, any_value(lgd) AS portfolio_lgd, {rnd('avg(pd)', 4)} AS avg_pd,
                   {rnd(f'sum({loss})', 2)} AS total_expected_loss, {pct(f'sum({loss})', 'sum(ead)', 4)} AS el_rate_pct,
                   {n_if('max_dpd >= 90')} AS stage_3_accounts, {n_if('pd >= 0.2e0 AND max_dpd < 90')} AS stage_2_accounts,
                   {n_if('pd < 0.2e0')} AS stage_1_accounts
            FROM risk""",
            "risk",
        ),
        "expected_loss_stage": compose(
            f"""
            SELECT {stage('Stage 3', 'Stage 2', 'Stage 1')}, count(*) AS accounts, {rnd('avg(pd)', 4)} AS avg_pd, lgd,
                   {whole('sum(ead)')} AS total_ead, {rnd(f'sum({loss})', 2)} AS total_expected_loss,
                   {pct(f'sum({loss})', 'sum(ead)', 4)} AS el_rate_pct
            FROM risk GROUP BY ALL""",
            "risk",
        ),
        "expected_loss_product": compose(
            f"""
            SELECT product_type, count(*) AS accounts, {rnd('avg(pd)', 4)} AS avg_pd, lgd,
                   {whole('sum(ead)')} AS total_ead, {rnd(f'sum({loss})', 2)} AS total_expected_loss,
                   {rnd('avg(pd * lgd)', 4)} AS avg_el_rate
            FROM risk JOIN cards USING (card_id) GROUP BY product_type, lgd""",
            "risk",
        ),
        "ecl_reserve_monthly": compose(f"""
            SELECT period_month, {whole('ead')} AS total_ead, pd, lgd, {rnd(loss, 2)} AS ecl_provision,
                   {rnd('pd * lgd * 1e2', 4)} AS provision_rate_pct
            FROM (SELECT period_month, sum({EAD}) AS ead, {rnd(div(n_if(DEFAULT), 'count(*)'), 4)} AS pd,
                         (SELECT {rnd(f'avg({LGD})', 4)} FROM writeoffs) AS lgd
                  FROM statements GROUP BY period_month)"""),
    }


def migration() -> dict[str, str]:
    to = {b: f"next_bucket = '{b}'" for b in BUCKETS}
    late = "('30-59', '60-89', '90+')"
    worse, better = f"{rank('next_bucket')} > {rank('current_bucket')}", f"{rank('next_bucket')} < {rank('current_bucket')}"
    return {
        "roll_matrix": compose(
            f"""
            SELECT current_bucket, count(*) AS total_accounts,
                   {', '.join(f'{n_if(to[b])} AS roll_to_{s}' for b, s in BUCKETS.items())},
                   {', '.join(f"{pct(n_if(to[b]), 'count(*)')} AS pct_to_{s}" for b, s in BUCKETS.items())}
            FROM moves GROUP BY current_bucket""",
            "moves",
        ),
        "roll_matrix_balance": compose(
            f"""
            SELECT current_bucket, {total('current_balance')} AS total_balance,
                   {', '.join(f"{total_if(to[b], 'current_balance')} AS bal_to_{s}" for b, s in BUCKETS.items())},
                   {', '.join(
                       f"{pct(total_if(to[b], 'current_balance'), 'sum(current_balance)')} AS bal_roll_to_{BUCKETS[b]}_pct"
                       for b in ('30-59', '60-89', '90+'))}
            FROM moves GROUP BY current_bucket""",
            "moves",
        ),
        "roll_trend": compose(
            f"""
            SELECT current_month, current_bucket, count(*) AS accounts,
                   {pct(n_if(worse), 'count(*)')} AS forward_roll_rate_pct, {pct(n_if(better), 'count(*)')} AS cure_rate_pct,
                   {pct(n_if('next_bucket = current_bucket'), 'count(*)')} AS stable_rate_pct
            FROM moves WHERE current_bucket <> '0' GROUP BY ALL""",
            "moves",
        ),
        "net_roll": compose(
            f"""
            SELECT coalesce(i.m, o.m) AS month, coalesce(i.b, o.b) AS bucket,
                   coalesce(i.n, 0) - coalesce(o.n, 0) AS net_account_flow,
                   {big('coalesce(i.bal, 0) - coalesce(o.bal, 0)')} AS net_balance_flow
            FROM (SELECT next_month AS m, next_bucket AS b, count(*) AS n, sum(next_balance) AS bal
                  FROM moves WHERE next_bucket <> '0' GROUP BY ALL) i
            FULL JOIN (SELECT current_month AS m, current_bucket AS b, count(*) AS n, sum(current_balance) AS bal
                       FROM moves WHERE current_bucket <> '0' AND next_bucket = '0' GROUP BY ALL) o
              ON i.m = o.m AND i.b = o.b""",
            "moves",
        ),
        "roll_region": compose(
            f"""
            SELECT region, current_bucket, count(*) AS accounts,
                   {pct(n_if(f"current_bucket IN ('0', '1-29') AND next_bucket IN {late}"), 'count(*)')}
                     AS new_delinquency_rate_pct,
                   {pct(n_if("next_bucket = '90+' AND current_bucket <> '90+'"), 'count(*)')} AS charge_off_flow_pct
            FROM moves JOIN cards USING (card_id) JOIN customers USING (customer_id)
            GROUP BY region, current_bucket""",
            "moves",
        ),
        "loss_projection": compose(
            f"""
            SELECT dpd_bucket, accounts, balance, coalesce(rate, 0e0) AS projected_default_rate,
                   {rnd('balance * coalesce(rate, 0e0)', 0)} AS projected_default_balance
            FROM (SELECT dpd_bucket, count(*) AS accounts, {total('statement_balance')} AS balance
                  FROM latest GROUP BY dpd_bucket)
            LEFT JOIN (SELECT current_bucket AS dpd_bucket, {rnd(div(n_if(to['90+']), 'count(*)'), 4)} AS rate
                       FROM moves GROUP BY current_bucket) USING (dpd_bucket)""",
            "latest",
            "moves",
        ),
    }


def vintage() -> dict[str, str]:
    at = lambda m: f"max(rate) FILTER (mob = {m}) AS default_rate_mob{m}"
    return {
        "vintage_curves": compose(
            f"""
            SELECT cohort_month, mob, count(*) AS accounts, {n_if(LATE)} AS delinquent_30plus,
                   {n_if(DEFAULT)} AS defaulted, {EXPOSURE} AS outstanding_balance,
                   {pct(n_if(LATE), 'count(*)', 4)} AS delinquency_rate_pct,
                   {pct(n_if(DEFAULT), 'count(*)', 4)} AS default_rate_pct
            FROM aged GROUP BY ALL""",
            "aged",
        ),
        "vintage_cumulative": compose(
            f"""
            SELECT cohort_month, mob, count(*) AS accounts_at_mob, {n_if('hit')} AS cumulative_defaults,
                   {pct(n_if('hit'), 'count(*)', 4)} AS cumulative_default_rate_pct
            FROM (
              SELECT now.card_id, now.cohort_month, now.mob, bool_or(past.days_past_due >= 90) AS hit
              FROM aged now JOIN aged past ON past.card_id = now.card_id AND past.mob <= now.mob
              GROUP BY ALL
            ) GROUP BY cohort_month, mob""",
            "aged",
        ),
        "vintage_key_mobs": compose(
            f"""
            SELECT cohort_month, {at(6)}, {at(12)}, {at(18)}, {at(24)}
            FROM (SELECT cohort_month, mob, {pct(n_if(DEFAULT), 'count(*)', 4)} AS rate FROM aged GROUP BY ALL)
            GROUP BY cohort_month""",
            "aged",
        ),
        "vintage_loss": compose(
            f"""
            SELECT cohort_month, original_balance, {big('coalesce(w, 0)')} AS written_off,
                   {big('coalesce(r, 0)')} AS recovered, {big('coalesce(w - r, 0)')} AS net_loss,
                   {pct('coalesce(w - r, 0)', 'original_balance', 4)} AS net_loss_rate_pct
            FROM (SELECT cohort_month, {EXPOSURE} AS original_balance FROM aged WHERE mob = 1 GROUP BY cohort_month)
            LEFT JOIN (
              SELECT cohort_month, sum(writeoff_amount) AS w, sum(recovery_amount) AS r
              FROM writeoffs JOIN (SELECT DISTINCT card_id, cohort_month FROM aged) USING (card_id)
              GROUP BY cohort_month
            ) USING (cohort_month)""",
            "aged",
        ),
        "vintage_income": compose(
            f"""
            SELECT income_band, cohort_month, mob, count(*) AS accounts,
                   {pct(n_if(LATE), 'count(*)', 4)} AS del_rate_pct, {pct(n_if(DEFAULT), 'count(*)', 4)} AS default_rate_pct
            FROM aged JOIN cards USING (card_id) JOIN customers USING (customer_id)
            GROUP BY income_band, cohort_month, mob""",
            "aged",
        ),
        "vintage_scorecard": compose(
            f"""
            SELECT CAST(date_trunc('year', cohort_month) AS DATE) AS vintage_year, {CARDS_SEEN} AS total_accounts,
                   count(DISTINCT cohort_month) AS months_in_vintage, {rnd('avg(statement_balance)', 0)} AS avg_balance,
                   {pct(n_if(LATE), 'count(*)', 4)} AS avg_del_rate_pct,
                   {pct(n_if(DEFAULT), 'count(*)', 4)} AS avg_default_rate_pct, max(days_past_due) AS peak_dpd_observed
            FROM aged GROUP BY ALL""",
            "aged",
        ),
        "early_life_delinquency": compose(
            f"""
            SELECT cohort_month, count(*) AS total_accounts, {n_if('worst >= 30')} AS early_delinquent,
                   {n_if('worst >= 90')} AS early_default,
                   {pct(n_if('worst >= 30'), 'count(*)', 4)} AS early_del_rate_pct,
                   {pct(n_if('worst >= 90'), 'count(*)', 4)} AS early_default_rate_pct
            FROM (SELECT cohort_month, card_id, max(days_past_due) FILTER (mob < 7) AS worst FROM aged GROUP BY ALL)
            GROUP BY cohort_month""",
            "aged",
        ),
    }
