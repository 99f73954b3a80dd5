"""All queries by name, each a function of a session and an order-table folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from revolva.functions.numeric import displayed
from revolva.operators import (
    book,
    charts,
    dashboards,
    default_model,
    default_probability,
    delinquency,
    expected_loss,
    exports,
    exposure,
    features,
    frames,
    kpis,
    load,
    loss_given_default,
    migration,
    pack,
    quality,
    vintage,
)
from revolva.sources import store

Query = Callable[[SparkSession, str], DataFrame]

# Filters of the registered overview; any others may be passed to the operator.
OVERVIEW_FILTERS = {
    "regions": ["ASIA", "EUROPE"],
    "income_bands": ["low", "medium"],
    "product_types": ["classic", "premium"],
    "first_month": date(2022, 6, 1),
    "last_month": date(2023, 12, 1),
}

# Averages that the profile view leaves unrounded.
PROFILE_AVERAGES = ("avg_utilization", "max_utilization", "avg_dpd", "avg_payment_ratio", "avg_balance")

# Run on the portfolio with planted faults.
ON_DIRTY = {
    "null_totals": load.null_totals,
    "dq_null_customers": quality.null_customers,
    "dq_null_cards": quality.null_cards,
    "dq_null_statements": quality.null_statements,
    "dq_dup_customers": quality.duplicate_customers,
    "dq_dup_cards": quality.duplicate_cards,
    "dq_dup_statements": quality.duplicate_statements,
    "dq_negative_balance": partial(quality.statement_issue, name="negative_balance"),
    "dq_negative_dpd": partial(quality.statement_issue, name="negative_dpd"),
    "dq_overpayment": partial(quality.statement_issue, name="overpayment"),
    "dq_bad_credit_limit": partial(quality.card_issue, name="bad_credit_limit"),
    "dq_over_limit": partial(quality.statement_issue, name="over_limit"),
    "dq_bucket_mismatch": partial(quality.statement_issue, name="dpd_bucket_mismatch"),
    "dq_orphan_cards": quality.orphan_cards,
    "dq_orphan_statements": quality.orphan_statements,
    "dq_orphan_writeoffs": quality.orphan_writeoffs,
    "profile_customers": quality.profile_customers,
    "profile_products": quality.profile_products,
    "profile_dpd_bucket": quality.profile_buckets,
    "monthly_completeness": quality.monthly_completeness,
    "dq_negative_writeoff": partial(quality.writeoff_issue, name="negative_writeoff"),
    "dq_recovery_exceeds": partial(quality.writeoff_issue, name="recovery_exceeds_writeoff"),
    "dq_lgd_range": quality.lgd_range,
    "dq_battery": quality.battery,
}

ON_CLEAN = {
    "row_counts": load.row_counts,
    "date_range": load.date_range,
    # feature views
    "credit_utilization": features.credit_utilization,
    "payment_behavior": features.payment_behavior,
    "customer_risk_profile": lambda p: displayed(features.customer_risk_profile(p), 6, *PROFILE_AVERAGES),
    "roll_rate_base": features.roll_rate_base,
    "vintage_base": features.vintage_base,
    "early_warning": features.early_warning,
    # key figures
    "kpi_portfolio": kpis.portfolio_summary,
    "kpi_dpd_bucket": kpis.by_bucket,
    "kpi_util_band": kpis.by_util_band,
    "kpi_payment_type": kpis.by_payment_type,
    "kpi_region": kpis.by_region,
    "kpi_income": kpis.by_income,
    "kpi_product": kpis.by_product,
    "kpi_monthly_trend": kpis.monthly_trend,
    "top_risk_accounts": kpis.top_risk_accounts,
    "report_pack": pack.pack,
    # delinquency
    "delinquency_mom": delinquency.month_on_month,
    "cure_rate": delinquency.cure_rate,
    "ewi_summary": delinquency.warning_summary,
    "delinquency_streaks": delinquency.delinquency_streaks,
    "balance_migration": delinquency.balance_migration,
    "first_payment_default": delinquency.first_payment_default,
    # advanced reports
    "cumulative_exposure": book.cumulative_exposure,
    "delinquency_bps": book.delinquency_bps,
    "rolling_util_3m": book.rolling_utilization,
    "rfm_scoring": book.rfm_scoring,
    "payment_gap": book.payment_gap,
    "stress_test": book.stress_test,
    "concentration_top100": book.concentration,
    "cohort_retention": book.cohort_retention,
    "collections_efficiency": book.collections_efficiency,
    "risk_decile": book.risk_decile,
    "lgd_proxy": book.lgd_proxy,
    "writeoffs_product_region": book.writeoffs_by_product_region,
    "limit_adequacy": book.limit_adequacy,
    "migration_pivot_counts": book.migration_counts,
    "activity_vs_delinquency": book.activity_by_delinquency,
    # probability of default
    "pd_portfolio": default_probability.portfolio_pd,
    "pd_monthly": default_probability.monthly_pd,
    "pd_region": default_probability.pd_by_region,
    "pd_income": default_probability.pd_by_income,
    "pd_product": default_probability.pd_by_product,
    "pd_util_band": default_probability.pd_by_util_band,
    "pd_mob_curve": default_probability.pd_by_age,
    "pd_score_12m": default_probability.score_12m,
    # loss given default
    "lgd_portfolio": loss_given_default.portfolio_lgd,
    "lgd_product": loss_given_default.lgd_by_product,
    "lgd_income": loss_given_default.lgd_by_income,
    "lgd_region": loss_given_default.lgd_by_region,
    "lgd_monthly": loss_given_default.lgd_by_month,
    "lgd_histogram": loss_given_default.lgd_histogram,
    "lgd_account_detail": loss_given_default.lgd_account_detail,
    "lgd_limit_band": loss_given_default.lgd_by_limit_band,
    # exposure at default
    "ead_account": exposure.account_ead,
    "ead_portfolio": exposure.portfolio_ead,
    "ead_product": exposure.ead_by_product,
    "ead_income": exposure.ead_by_income,
    "ead_region": exposure.ead_by_region,
    "ead_ccf_sensitivity": exposure.ccf_sensitivity,
    "ead_monthly": exposure.monthly_ead,
    # expected loss
    "expected_loss_account": expected_loss.by_account,
    "expected_loss_portfolio": expected_loss.summary,
    "expected_loss_stage": expected_loss.by_stage,
    "expected_loss_product": expected_loss.by_product,
    "ecl_reserve_monthly": expected_loss.monthly_reserve,
    # roll rates
    "roll_matrix": migration.roll_matrix,
    "roll_matrix_balance": migration.roll_matrix_balance,
    "roll_trend": migration.roll_trend,
    "net_roll": migration.net_roll,
    "roll_region": migration.roll_by_region,
    "loss_projection": migration.loss_projection,
    # vintages
    "vintage_curves": vintage.curves,
    "vintage_cumulative": vintage.cumulative,
    "vintage_key_mobs": vintage.key_ages,
    "vintage_loss": vintage.loss_rate,
    "vintage_income": vintage.by_income,
    "vintage_scorecard": vintage.scorecard,
    "early_life_delinquency": vintage.early_life,
    # dataframe-style variants
    "master": frames.master,
    "master_features": frames.master_features,
    "payment_type_py": frames.payment_types,
    "util_band_py": frames.util_bands,
    "kpi_summary_py": frames.kpi_summary,
    "card_features": frames.card_features,
    "pd_score_py": frames.pd_score,
    "pd_portfolio_py": frames.pd_portfolio,
    "pd_region_py": frames.pd_by_region,
    "lgd_writeoffs_py": frames.writeoff_lgd,
    "lgd_py": frames.lgd_summary,
    "lgd_product_py": frames.lgd_by_product,
    "ead_accounts_py": frames.latest_ead,
    "ead_py": frames.ead_summary,
    "expected_loss_py": frames.expected_loss,
    "stage_summary_py": frames.stage_summary,
    "loss_totals_py": frames.loss_totals,
    "roll_matrix_long": frames.roll_matrix_long,
    "roll_matrix_wide": frames.roll_matrix_wide,
    "vintage_curves_py": frames.vintage_curves,
    # chart datasets
    "chart_dpd_dist": charts.bucket_distribution,
    "chart_util_dist": charts.util_distribution,
    "monthly_trend_py": charts.monthly_trend,
    "vintage_sampled": charts.vintage_sampled,
    "chart_stage_dist": charts.stage_distribution,
    "chart_el_by_stage": charts.loss_by_stage,
    "pd_histogram": charts.pd_histogram,
    "region_util": charts.region_util,
    "income_util": charts.income_util,
    # extracts
    "export_portfolio": exports.portfolio,
    "export_sample": partial(exports.portfolio_sample, share=0.1),
    "export_monthly": exports.monthly_trend,
    "export_vintage": exports.vintage_curves,
    "export_roll": exports.roll_rates,
    "export_segments": exports.segments,
    "export_expected_loss": exports.expected_loss,
    "final_summary_core": exports.final_summary,
    # dashboard calculations
    "bi_overview_cards": partial(dashboards.overview_cards, **OVERVIEW_FILTERS),
    "bi_overview_breakdown": dashboards.overview_breakdown,
    "bi_running_avg_mom": dashboards.running_average_change,
    "bi_vintage_mob12": dashboards.vintage_at_age,
    "bi_cohort_heatmap": dashboards.cohort_heatmap,
    "bi_forward_roll_trend": dashboards.forward_roll_trend,
    "bi_region_delinquency": dashboards.region_delinquency,
    "bi_income_scatter": dashboards.income_scatter,
    "bi_product_income_heatmap": dashboards.product_income_heatmap,
    "bi_exposure_treemap": dashboards.exposure_treemap,
    "bi_el_cards": dashboards.loss_cards,
    "bi_stage_charts": dashboards.stage_charts,
    "bi_pd_bins": dashboards.score_bins,
    "bi_top50_el": dashboards.top_losses,
    "bi_el_product_income": dashboards.loss_rate_heatmap,
    # default model, up to the fit
    "class_balance": default_model.class_balance,
    "default_model_split": default_model.split,
    # evaluation of the behavioural score, which SQL can express
    "score_auc": default_model.score_auc,
    "score_roc": default_model.score_roc,
}

# Run on the model fitted to the clean portfolio.
ON_MODEL = {
    "default_model_scale": default_model.scaled,
    "default_model_fit": lambda m: displayed(default_model.coefficients(m), 6, "weight"),
    "default_model_predict": lambda m: displayed(default_model.predictions(m), 6, "probability"),
    "default_model_auc": default_model.auc,
    "default_model_report": lambda m: displayed(default_model.report(m), 8, "precision", "recall", "f1_score"),
    "default_model_confusion": default_model.confusion,
    "default_model_roc": default_model.roc,
}

_fitted: dict[tuple[str, str, str], default_model.FittedModel] = {}


def fitted_model(spark: SparkSession, sf_dir: str) -> default_model.FittedModel:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), store.fingerprint(spark, sf_dir))
    if key not in _fitted:
        _fitted[key] = default_model.fit(store.load(spark, sf_dir))
    return _fitted[key]


def _final_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = default_model.auc(fitted_model(spark, sf_dir))
    return exports.final_summary(store.load(spark, sf_dir), score)


def _export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = store.load(spark, sf_dir)
    return exports.export_files(p, f"{store.shared_folder(spark)}/revolva-exports-{p.version}")


def build() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for name, op in ON_CLEAN.items():
        out[name] = lambda spark, sf_dir, op=op: op(store.load(spark, sf_dir))
    for name, op in ON_DIRTY.items():
        out[name] = lambda spark, sf_dir, op=op: op(store.load_dirty(spark, sf_dir))
    for name, op in ON_MODEL.items():
        out[name] = lambda spark, sf_dir, op=op: op(fitted_model(spark, sf_dir))
    out["final_summary"] = _final_summary
    out["export_files"] = _export_files
    return out
