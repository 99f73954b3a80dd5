"""Dataframe-style variants of the measures.

They differ from the report operators on purpose: left joins instead of inner
ones, half-even rounding, capped payment ratios, right-closed bands, rates on
statements where the reports count cards.

Rounded ratios are summed as whole ten-thousandths, so every mean here is exact
and does not depend on how the rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revolva.config import DEFAULTS, RiskConfig
from revolva.functions.bands import (
    BUCKETS,
    dpd_at_least,
    exposure_at_default,
    lgd,
    logistic,
    payment_ratio,
    payment_type,
    severity,
    util_band_right_closed,
    utilization,
)
from revolva.functions.numeric import half_even, ratio, rows, total
from revolva.operators.default_probability import risk_driver
from revolva.plans import panel
from revolva.plans.portfolio import Portfolio

_UNIT = 10_000.0


def _clip(c: Column, low: float, high: float) -> Column:
    """Cap a value, keeping NULL."""
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def mean4(c: Column | str) -> Column:
    """Mean of a column that holds values rounded to four decimals."""
    c = F.col(c) if isinstance(c, str) else c
    return ratio(F.sum(F.rint(c * _UNIT).cast("bigint")), F.count(c)) / _UNIT


def features(statements: DataFrame, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """Statements with the row-level features of the analysis."""
    revolving = F.col("statement_balance") - F.col("paid_amount")
    paid_share = _clip(F.coalesce(payment_ratio(), F.lit(0.0)), 0.0, 1.0)
    return statements.select(
        "*",
        half_even(utilization(), 4).alias("utilization"),
        half_even(paid_share, 4).alias("payment_ratio"),
        F.when(revolving < 0, 0).otherwise(revolving).alias("revolving_balance"),
        F.coalesce(dpd_at_least(cfg.delinquent_dpd), F.lit(False)).cast("int").alias("is_delinquent"),
        F.coalesce(dpd_at_least(cfg.default_dpd), F.lit(False)).cast("int").alias("is_default"),
        payment_type().alias("payment_type"),
    ).withColumn("util_band", util_band_right_closed(F.col("utilization")))


def with_dimensions(df: DataFrame, p: Portfolio) -> DataFrame:
    """Left join with card and customer, without the card's own limit."""
    return df.join(p.holders.drop("card_limit", "has_customer"), "card_id", "left")


def master(p: Portfolio) -> DataFrame:
    return with_dimensions(p.statements, p)


def master_features(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return with_dimensions(features(p.statements, cfg), p)


def payment_types(p: Portfolio) -> DataFrame:
    return features(p.statements).groupBy("payment_type").agg(rows().alias("statements"))


def util_bands(p: Portfolio) -> DataFrame:
    """Statements per right-closed band; those without a ratio have no band."""
    return features(p.statements).groupBy("util_band").agg(rows().alias("statements"))


def kpi_summary(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return features(p.statements, cfg).agg(
        total("statement_balance").alias("total_exposure"),
        mean4("utilization").alias("avg_utilization"),
        F.avg("is_delinquent").alias("delinquency_rate"),
        F.avg("is_default").alias("default_rate"),
        F.avg((F.col("payment_type") == "No Payment").cast("int")).alias("no_payment_rate"),
    )


def _card_measures() -> list[Column]:
    return [
        mean4("utilization").alias("avg_util"),
        F.max("utilization").alias("max_util"),
        F.avg("days_past_due").alias("avg_dpd"),
        F.max("days_past_due").alias("max_dpd"),
        F.sum("is_delinquent").alias("del_months"),
        mean4("payment_ratio").alias("avg_pay_ratio"),
        F.avg("revolving_balance").alias("avg_rev_bal"),
        F.max("is_default").alias("default_flag"),
        # A panel has one statement per card and month.
        F.count("period_month").alias("months_on_book"),
    ]


def card_features(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return features(p.statements, cfg).groupBy("card_id").agg(*_card_measures())


def _score(cfg: RiskConfig) -> Column:
    """The capped score from card measures."""
    driver = risk_driver(
        _clip(F.col("avg_util"), 0.0, 1.0),
        F.col("avg_dpd"),
        F.col("del_months"),
        _clip(F.col("avg_pay_ratio"), 0.0, 1.0),
        cfg,
    )
    return half_even(logistic(driver), 4)


def pd_scores(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """Card features with the capped score."""
    return card_features(p, cfg).withColumn("pd_score", _score(cfg))


def pd_score(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return pd_scores(p, cfg).select("card_id", "pd_score")


def pd_portfolio(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return pd_scores(p, cfg).agg(
        F.avg("default_flag").alias("portfolio_pd"), mean4("pd_score").alias("avg_pd_score")
    )


def _segment_rates(p: Portfolio, key: str, cfg: RiskConfig) -> DataFrame:
    """Statement counts and feature sums per segment, from one row per card."""
    per_card = features(p.statements, cfg).groupBy("card_id").agg(
        rows().alias("n"),
        F.sum("is_delinquent").alias("n30"),
        F.sum("is_default").alias("n90"),
        F.sum(F.rint(F.col("utilization") * _UNIT).cast("bigint")).alias("util_units"),
        F.count("utilization").alias("n_util"),
    )
    return (
        with_dimensions(per_card, p)
        .where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            (ratio(F.sum("util_units"), F.sum("n_util")) / _UNIT).alias("avg_util"),
            ratio(F.sum("n30"), F.sum("n")).alias("del_rate"),
            ratio(F.sum("n90"), F.sum("n")).alias("def_rate"),
        )
    )


def pd_by_region(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """Share of statements in default per region."""
    return (
        _segment_rates(p, "region", cfg)
        .select("region", half_even("def_rate", 4).alias("pd"))
        .orderBy("region")
    )


def util_by(p: Portfolio, key: str, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return (
        _segment_rates(p, key, cfg)
        .select(key, "avg_util", "del_rate")
        .orderBy(F.desc("del_rate"), key)
    )


def writeoff_lgd(p: Portfolio) -> DataFrame:
    return p.writeoffs.withColumn("lgd", half_even(lgd(), 4))


def lgd_summary(p: Portfolio) -> DataFrame:
    """Mean of the rounded loss shares, and the amounts."""
    return (
        writeoff_lgd(p)
        .agg(
            total("writeoff_amount").alias("total_written_off"),
            total("recovery_amount").alias("total_recovered"),
            mean4("lgd").alias("portfolio_lgd"),
        )
        .select(
            "total_written_off",
            "total_recovered",
            (F.col("total_written_off") - F.col("total_recovered")).alias("net_loss"),
            "portfolio_lgd",
            (1 - F.col("portfolio_lgd")).alias("recovery_rate"),
        )
    )


def lgd_by_product(p: Portfolio) -> DataFrame:
    return (
        writeoff_lgd(p)
        .join(p.cards.select("card_id", "product_type"), "card_id")
        .groupBy("product_type")
        .agg(half_even(mean4("lgd"), 4).alias("lgd"))
        .orderBy("product_type")
    )


def latest_ead(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """Exposure per card in the last month, rounded to whole units."""
    return p.latest_statements().select(
        "card_id",
        "statement_balance",
        "credit_limit",
        (F.col("credit_limit") - F.col("statement_balance")).alias("unused_limit"),
        half_even(exposure_at_default(cfg.ccf), 0).alias("ead"),
    )


def ead_summary(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return (
        latest_ead(p, cfg)
        .agg(
            total("statement_balance").alias("portfolio_balance"),
            F.sum("ead").alias("portfolio_ead"),
            total("credit_limit").alias("portfolio_max_exposure"),
        )
        .withColumn("ead_uplift", ratio("portfolio_ead", "portfolio_balance"))
    )


def expected_loss(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """Every card with a score; exposure is NULL without a statement in the last month.

    Score and exposure come from one pass over the statements.
    """
    in_last_month = F.col("period_month") == p.latest_month()
    exposure = F.max(F.when(in_last_month, half_even(exposure_at_default(cfg.ccf), 0))).alias("ead")
    mean_lgd = writeoff_lgd(p).select(mean4("lgd").alias("lgd")).scalar()
    stage = (
        F.when(F.col("max_dpd") >= cfg.default_dpd, "Stage 3")
        .when(F.col("pd_score") >= cfg.stage_2_score, "Stage 2")
        .otherwise("Stage 1")
    )
    return (
        features(p.statements, cfg)
        .groupBy("card_id")
        .agg(*_card_measures(), exposure)
        .withColumn("pd_score", _score(cfg))
        .withColumn("lgd", mean_lgd)
        .select(
            "card_id",
            "pd_score",
            "max_dpd",
            "ead",
            "lgd",
            half_even(F.col("pd_score") * F.col("lgd") * F.col("ead"), 2).alias("expected_loss"),
            half_even(F.col("pd_score") * F.col("lgd") * 100, 4).alias("el_rate_pct"),
            stage.alias("ifrs9_stage"),
        )
    )


def cents(c: str) -> Column:
    """Sum of amounts rounded to two decimals, added up as whole cents; 0 when empty."""
    return F.coalesce(F.sum(F.rint(F.col(c) * 100).cast("bigint")) / 100.0, F.lit(0.0))


def stage_summary(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return (
        expected_loss(p, cfg)
        .groupBy("ifrs9_stage")
        .agg(
            rows().alias("accounts"),
            F.coalesce(F.sum("ead"), F.lit(0.0)).alias("total_ead"),
            cents("expected_loss").alias("total_el"),
        )
        .withColumn("el_rate", half_even(ratio("total_el", "total_ead"), 4))
        .orderBy("ifrs9_stage")
    )


def loss_totals(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return (
        expected_loss(p, cfg)
        .agg(
            cents("expected_loss").alias("total_el"),
            F.sum("ead").alias("total_ead"),
            *[
                F.count_if(F.col("ifrs9_stage") == f"Stage {i}").alias(f"stage_{i}_accounts")
                for i in (1, 2, 3)
            ],
        )
        .withColumn("el_rate", ratio("total_el", "total_ead"))
    )


def roll_rates(p: Portfolio) -> DataFrame:
    counts = (
        panel.transitions(p.statements)
        .where(F.col("next_bucket").isNotNull())
        .groupBy(F.col("current_bucket").alias("dpd_bucket"), "next_bucket")
        .agg(rows().alias("count"))
    )
    per_bucket = F.sum("count").over(Window.partitionBy("dpd_bucket"))
    rate = half_even(ratio("count", "total") * 100, 2)
    return counts.withColumn("total", per_bucket).withColumn("roll_rate", rate)


def roll_matrix_long(p: Portfolio) -> DataFrame:
    return roll_rates(p).orderBy(severity("dpd_bucket"), severity("next_bucket"))


def roll_matrix_wide(p: Portfolio) -> DataFrame:
    """Five rows and five rate columns; a move never seen has rate zero."""
    long = roll_rates(p)
    labels = F.explode(F.array(*[F.lit(b) for b in BUCKETS]))
    every = p.statements.sparkSession.range(1).select(labels.alias("dpd_bucket"))
    wide = long.groupBy("dpd_bucket").pivot("next_bucket", list(BUCKETS)).agg(F.first("roll_rate"))
    return every.join(F.broadcast(wide), "dpd_bucket", "left").na.fill(0.0).orderBy(severity("dpd_bucket"))


def cohort_rates(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return (
        panel.aged(p.statements)
        .groupBy("cohort_month", "mob")
        .agg(
            rows().alias("accounts"),
            F.count_if(dpd_at_least(cfg.default_dpd)).alias("defaulted"),
            F.count_if(dpd_at_least(cfg.delinquent_dpd)).alias("delinquent"),
        )
        .select(
            "*",
            half_even(ratio("defaulted", "accounts") * 100, 4).alias("default_rate"),
            half_even(ratio("delinquent", "accounts") * 100, 4).alias("delinquency_rate"),
        )
    )


def vintage_curves(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return cohort_rates(p, cfg).orderBy("cohort_month", "mob")
