"""SQL for the dataframe-style variants, charts, extracts, dashboards and split."""

from __future__ import annotations

from oracle.sql import (
    DEFAULT,
    EAD,
    LATE,
    LGD,
    big,
    cents,
    div,
    even,
    mean4,
    n_if,
    pct,
    rank,
    rnd,
    total,
)
from oracle.tables import compose

BUCKETS = ("0", "1-29", "30-59", "60-89", "90+")
FEATURES = "avg_util, max_util, avg_pay_ratio, avg_dpd, del_months, avg_rev_bal"

ROLL_LONG = f"""
    SELECT current_bucket AS dpd_bucket, next_bucket, count(*) AS count,
           {big('sum(count(*)) OVER (PARTITION BY current_bucket)')} AS total,
           {even(f"{div('count(*)', 'sum(count(*)) OVER (PARTITION BY current_bucket)')} * 1e2", 2)} AS roll_rate
    FROM moves GROUP BY current_bucket, next_bucket"""
CURVES = f"""
    SELECT cohort_month, mob, count(*) AS accounts, {n_if(DEFAULT)} AS defaulted, {n_if(LATE)} AS delinquent,
           {even(f"{div(n_if(DEFAULT), 'count(*)')} * 1e2", 4)} AS default_rate,
           {even(f"{div(n_if(LATE), 'count(*)')} * 1e2", 4)} AS delinquency_rate
    FROM aged GROUP BY cohort_month, mob"""
MONTHLY = f"""
    SELECT period_month, count(*) AS total, {n_if(LATE)} AS del30, {n_if(DEFAULT)} AS def90,
           {total('statement_balance')} AS exposure, {div(n_if(LATE), 'count(*)')} * 1e2 AS del_rate,
           {div(n_if(DEFAULT), 'count(*)')} * 1e2 AS def_rate
    FROM statements GROUP BY period_month"""
LGD4 = even(LGD, 4)


def frames() -> dict[str, str]:
    share = lambda flag: div(f"sum({flag})", "count(*)")
    totals = f"""
        SELECT {cents('expected_loss')} AS total_el, sum(ead) AS total_ead,
               {', '.join(f"{n_if(f'''ifrs9_stage = 'Stage {i}' ''')} AS stage_{i}_accounts" for i in (1, 2, 3))},
               {div(cents('expected_loss'), 'sum(ead)')} AS el_rate
        FROM el"""
    wide = ", ".join(
        f"coalesce(max(roll_rate) FILTER (next_bucket = '{b}'), 0e0) AS \"{b}\"" for b in BUCKETS
    )
    return {
        "master": compose("""
            SELECT s.*, ca.customer_id, product_type, region, income_band, age, tenure_years
            FROM statements s LEFT JOIN cards ca ON ca.card_id = s.card_id
            LEFT JOIN customers cu ON cu.customer_id = ca.customer_id"""),
        "master_features": compose("SELECT * FROM wide", "wide"),
        "payment_type_py": compose("SELECT payment_type, count(*) AS statements FROM feat GROUP BY ALL", "feat"),
        "util_band_py": compose("SELECT util_band, count(*) AS statements FROM feat GROUP BY ALL", "feat"),
        "kpi_summary_py": compose(
            f"""
            SELECT {total('statement_balance')} AS total_exposure, {mean4('utilization')} AS avg_utilization,
                   {share('is_delinquent')} AS delinquency_rate, {share('is_default')} AS default_rate,
                   {div(n_if("payment_type = 'No Payment'"), 'count(*)')} AS no_payment_rate
            FROM wide""",
            "wide",
        ),
        "card_features": compose("SELECT * EXCLUDE (pd_score) FROM scores", "scores"),
        "pd_score_py": compose("SELECT card_id, pd_score FROM scores", "scores"),
        "pd_portfolio_py": compose(
            f"SELECT avg(default_flag) AS portfolio_pd, {mean4('pd_score')} AS avg_pd_score FROM scores", "scores"
        ),
        "pd_region_py": compose(
            f"SELECT region, {even(share('is_default'), 4)} AS pd FROM wide WHERE region IS NOT NULL GROUP BY region",
            "wide",
        ),
        "lgd_writeoffs_py": compose(f"SELECT *, {LGD4} AS lgd FROM writeoffs"),
        "lgd_py": compose(f"""
            SELECT {total('writeoff_amount')} AS total_written_off, {total('recovery_amount')} AS total_recovered,
                   {total('writeoff_amount - recovery_amount')} AS net_loss, {mean4(LGD4)} AS portfolio_lgd,
                   1e0 - {mean4(LGD4)} AS recovery_rate
            FROM writeoffs"""),
        "lgd_product_py": compose(
            f"SELECT product_type, {even(mean4(LGD4), 4)} AS lgd FROM losses GROUP BY product_type", "losses"
        ),
        "ead_accounts_py": compose(
            f"""
            SELECT card_id, statement_balance, credit_limit, credit_limit - statement_balance AS unused_limit,
                   {even(EAD, 0)} AS ead
            FROM latest""",
            "latest",
        ),
        "ead_py": compose(
            f"""
            SELECT {total('statement_balance')} AS portfolio_balance, sum({even(EAD, 0)}) AS portfolio_ead,
                   {total('credit_limit')} AS portfolio_max_exposure,
                   {div(f'sum({even(EAD, 0)})', 'sum(statement_balance)')} AS ead_uplift
            FROM latest""",
            "latest",
        ),
        "expected_loss_py": compose("SELECT * FROM el", "el"),
        "stage_summary_py": compose(
            f"""
            SELECT ifrs9_stage, count(*) AS accounts, coalesce(sum(ead), 0e0) AS total_ead,
                   {cents('expected_loss')} AS total_el, {even(div(cents('expected_loss'), 'sum(ead)'), 4)} AS el_rate
            FROM el GROUP BY ifrs9_stage""",
            "el",
        ),
        "loss_totals_py": compose(totals, "el"),
        "roll_matrix_long": compose(ROLL_LONG, "moves"),
        "roll_matrix_wide": compose(
            f"""
            SELECT dpd_bucket, {wide}
            FROM (SELECT unnest({list(BUCKETS)}) AS dpd_bucket) LEFT JOIN ({ROLL_LONG}) USING (dpd_bucket)
            GROUP BY dpd_bucket""",
            "moves",
        ),
        "vintage_curves_py": compose(CURVES, "aged"),
    }


def charts() -> dict[str, str]:
    util_by = lambda key: compose(
        f"""
        SELECT {key}, {mean4('utilization')} AS avg_util, {div('sum(is_delinquent)', 'count(*)')} AS del_rate
        FROM wide WHERE {key} IS NOT NULL GROUP BY {key}""",
        "wide",
    )
    return {
        "chart_dpd_dist": compose(f"""
            SELECT dpd_bucket, count(card_id) AS account_months
            FROM (SELECT unnest({list(BUCKETS)}) AS dpd_bucket) LEFT JOIN statements USING (dpd_bucket)
            GROUP BY dpd_bucket"""),
        "chart_util_dist": compose(
            "SELECT util_band, count(*) AS account_months FROM feat WHERE util_band IS NOT NULL GROUP BY ALL", "feat"
        ),
        "monthly_trend_py": compose(MONTHLY),
        "vintage_sampled": compose(
            f"""
            SELECT cohort_month, mob, default_rate FROM ({CURVES})
            WHERE cohort_month IN (
              SELECT cohort_month FROM (SELECT DISTINCT cohort_month FROM aged)
              QUALIFY row_number() OVER (ORDER BY cohort_month) % 3 = 1
            )""",
            "aged",
        ),
        "chart_stage_dist": compose("SELECT ifrs9_stage, count(*) AS accounts FROM el GROUP BY ALL", "el"),
        "chart_el_by_stage": compose(
            f"SELECT ifrs9_stage, {cents('expected_loss')} AS expected_loss FROM el GROUP BY ALL", "el"
        ),
        "pd_histogram": compose(
            """
            SELECT CAST(bin AS INT) AS bin, lo + bin * ((hi - lo) / 40e0) AS bin_start,
                   lo + (bin + 1) * ((hi - lo) / 40e0) AS bin_end, count(card_id) AS accounts
            FROM (SELECT unnest(range(40)) AS bin)
            CROSS JOIN (SELECT min(pd_score) AS lo, max(pd_score) AS hi FROM scores)
            LEFT JOIN scores ON least(floor((pd_score - lo) / ((hi - lo) / 40e0)), 39) = bin
            GROUP BY bin, lo, hi""",
            "scores",
        ),
        "region_util": util_by("region"),
        "income_util": util_by("income_band"),
    }


SUMMARY = f"""
    SELECT (SELECT count(*) FROM customers) AS customers, (SELECT count(*) FROM cards) AS cards,
           (SELECT count(*) FROM statements) AS statements, (SELECT count(*) FROM writeoffs) AS writeoffs,
           (SELECT min(period_month) FROM statements) AS min_month,
           (SELECT max(period_month) FROM statements) AS max_month,
           (SELECT avg(default_flag) FROM scores) AS portfolio_pd,
           (SELECT {mean4(LGD4)} FROM writeoffs) AS portfolio_lgd,
           (SELECT sum({even(EAD, 0)}) FROM latest) AS portfolio_ead,
           {cents('expected_loss')} AS expected_loss, {div(cents('expected_loss'), 'sum(ead)')} AS el_rate,
           {n_if("ifrs9_stage = 'Stage 1'")} AS stage_1_accounts,
           {n_if("ifrs9_stage = 'Stage 2'")} AS stage_2_accounts,
           {n_if("ifrs9_stage = 'Stage 3'")} AS stage_3_accounts
    FROM el"""


def exports() -> dict[str, str]:
    return {
        "export_portfolio": compose("SELECT * FROM wide", "wide"),
        "export_sample": compose("SELECT * FROM t1", "t1"),
        "export_monthly": compose(MONTHLY),
        "export_vintage": compose(CURVES, "aged"),
        "export_roll": compose(ROLL_LONG, "moves"),
        "export_segments": compose("SELECT * FROM segments", "segments"),
        "export_expected_loss": compose("SELECT * FROM el_wide", "el_wide"),
        "export_files": compose(
            " UNION ALL ".join(
                f"SELECT '{name}' AS export, count(*) AS rows FROM ({body})"
                for name, body in (
                    ("T1_portfolio_overview", "SELECT * FROM wide"),
                    ("T2_monthly_trend", MONTHLY),
                    ("T3_vintage_curves", CURVES),
                    ("T4_roll_rate_matrix", ROLL_LONG),
                    ("T5_utilization_segments", "SELECT * FROM segments"),
                    ("T6_expected_loss", "SELECT * FROM el_wide"),
                )
            ),
            "wide",
            "aged",
            "moves",
            "segments",
            "el_wide",
        ),
        "score_auc": compose(
            f"""
            SELECT {rnd('CAST(sum(CASE WHEN a.pd_score > b.pd_score THEN 2 WHEN a.pd_score = b.pd_score THEN 1 ELSE 0 END * a.n * b.n) AS DOUBLE) / (2 * sum(a.n * b.n))', 8)} AS roc_auc
            FROM (SELECT pd_score, count(*) AS n FROM scores WHERE default_flag = 1 GROUP BY ALL) a,
                 (SELECT pd_score, count(*) AS n FROM scores WHERE default_flag = 0 GROUP BY ALL) b""",
            "scores",
        ),
        "score_roc": compose(
            """
            SELECT CAST(NULL AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr
            UNION ALL
            SELECT t.pd_score, CAST((SELECT count(*) FROM scores s WHERE default_flag = 0 AND s.pd_score >= t.pd_score) AS DOUBLE)
                     / (SELECT count(*) FROM scores WHERE default_flag = 0),
                   CAST((SELECT count(*) FROM scores s WHERE default_flag = 1 AND s.pd_score >= t.pd_score) AS DOUBLE)
                     / (SELECT count(*) FROM scores WHERE default_flag = 1)
            FROM (SELECT DISTINCT pd_score FROM scores) t""",
            "scores",
        ),
        "final_summary_core": compose(
            SUMMARY,
            "latest",
            "el",
        ),
    }


def dashboards() -> dict[str, str]:
    return {
        "bi_overview_cards": compose(
            f"""
            SELECT {total('statement_balance')} AS total_exposure, avg(is_delinquent) AS delinquency_rate,
                   avg(is_default) AS default_rate, {mean4('utilization')} AS avg_utilization
            FROM wide WHERE region IN ('ASIA', 'EUROPE') AND income_band IN ('low', 'medium')
              AND product_type IN ('classic', 'premium') AND period_month BETWEEN DATE '2022-06-01' AND DATE '2023-12-01'""",
            "wide",
        ),
        "bi_overview_breakdown": compose(
            " UNION ALL ".join(
                f"SELECT '{c}' AS dimension, {c} AS label, count(*) AS accounts FROM wide GROUP BY ALL"
                for c in ("dpd_bucket", "util_band", "payment_type")
            ),
            "wide",
        ),
        "bi_running_avg_mom": compose(f"""
            SELECT period_month, {rnd('del_rate', 8)} AS del_rate, {rnd('r', 8)} AS running_avg,
                   {rnd('r - lag(r) OVER (ORDER BY period_month)', 8)} AS running_avg_change
            FROM (SELECT *, avg(del_rate) OVER (ORDER BY period_month) AS r FROM ({MONTHLY}))"""),
        "bi_vintage_mob12": compose(f"SELECT cohort_month, default_rate FROM ({CURVES}) WHERE mob = 12", "aged"),
        "bi_cohort_heatmap": compose(
            f"SELECT cohort_month, mob, delinquency_rate, accounts, defaulted FROM ({CURVES})", "aged"
        ),
        "bi_forward_roll_trend": compose(
            f"""
            SELECT current_month, count(*) AS accounts, {n_if(f"{rank('next_bucket')} >= 3")} AS rolled,
                   {pct(n_if(f"{rank('next_bucket')} >= 3"), 'count(*)')} AS forward_roll_pct
            FROM moves WHERE {rank('current_bucket')} <= 2 GROUP BY ALL""",
            "moves",
        ),
        "bi_region_delinquency": compose(
            f"SELECT region, {rnd('avg(del_rate)', 8)} AS avg_del_rate FROM segments GROUP BY ALL", "segments"
        ),
        "bi_income_scatter": compose(
            f"""
            SELECT income_band, {rnd('avg(avg_util)', 8)} AS avg_util, {rnd('avg(del_rate)', 8)} AS del_rate,
                   {total('accounts')} AS accounts
            FROM segments GROUP BY ALL""",
            "segments",
        ),
        "bi_product_income_heatmap": compose(
            f"""
            SELECT product_type, income_band, {rnd('avg(del_rate)', 8)} AS del_rate
            FROM segments GROUP BY ALL""",
            "segments",
        ),
        "bi_exposure_treemap": compose(
            f"""
            SELECT region, income_band, {total('exposure')} AS exposure, {rnd('avg(del_rate)', 8)} AS del_rate
            FROM segments GROUP BY ALL""",
            "segments",
        ),
        "bi_el_cards": compose(
            f"""
            SELECT {cents('expected_loss')} AS total_expected_loss, {mean4('pd_score')} AS avg_pd_score,
                   {rnd('avg(lgd)', 8)} AS avg_lgd, {rnd(div(cents('expected_loss'), 'sum(ead)'), 8)} AS el_rate
            FROM el_wide""",
            "el_wide",
        ),
        "bi_stage_charts": compose(
            f"""
            SELECT ifrs9_stage, count(*) AS accounts, {cents('expected_loss')} AS expected_loss
            FROM el_wide GROUP BY ALL""",
            "el_wide",
        ),
        "bi_pd_bins": compose(
            """
            SELECT CAST(CAST(round_even(pd_score * 1e4, 0) AS BIGINT) // 500 * 5 AS DOUBLE) / 1e2 AS pd_bin,
                   count(*) AS accounts
            FROM el_wide GROUP BY ALL""",
            "el_wide",
        ),
        "bi_top50_el": compose(
            """
            SELECT card_id, region, product_type, ead, pd_score, expected_loss, el_rate_pct, ifrs9_stage
            FROM el_wide ORDER BY expected_loss DESC NULLS LAST, card_id LIMIT 50""",
            "el_wide",
        ),
        "bi_el_product_income": compose(
            f"""
            SELECT product_type, income_band, {mean4('el_rate_pct')} AS avg_el_rate_pct
            FROM el_wide GROUP BY ALL""",
            "el_wide",
        ),
    }


def default_model() -> dict[str, str]:
    split = f"""
        SELECT card_id, default_flag, {FEATURES},
               CASE WHEN row_number() OVER (PARTITION BY default_flag ORDER BY md5('42|' || CAST(card_id AS VARCHAR)), card_id)
                         <= ceil(0.2e0 * count(*) OVER (PARTITION BY default_flag))
                    THEN 'test' ELSE 'train' END AS split
        FROM scores"""
    names = FEATURES.split(", ")
    z = ", ".join(f"round((x.{c} - t.m_{c}) / t.s_{c}, 6) AS z_{c}" for c in names)
    moments = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in names)
    return {
        "class_balance": compose("SELECT default_flag, count(*) AS cards FROM scores GROUP BY ALL", "scores"),
        "default_model_split": compose(split, "scores"),
        "default_model_scale": compose(
            f"""
            SELECT x.card_id, x.split, {z}
            FROM ({split}) x CROSS JOIN (SELECT {moments} FROM ({split}) WHERE split = 'train') t""",
            "scores",
        ),
    }
