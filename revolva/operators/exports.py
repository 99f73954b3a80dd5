"""Dashboard-ready extracts and the closing summary.

``EXPORTS`` names the six files; ``write_all`` writes them as CSV folders.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from revolva.config import DEFAULTS, RiskConfig
from revolva.functions.numeric import ratio, rows, total
from revolva.operators import charts, frames
from revolva.plans import sampling
from revolva.plans.portfolio import Portfolio
from revolva.sources import files
from revolva.sources.readers import write_csv

MANIFEST = "exports.json"


def portfolio(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """The whole master table with its features."""
    return frames.master_features(p, cfg)


def portfolio_sample(p: Portfolio, share: float, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """A uniform sample of the master table, for tools that cannot hold all of it.

    Statements are drawn first; only the drawn ones are widened and joined.
    """
    drawn = sampling.sample_share(p.statements, share, cfg.seed, "card_id", "period_month")
    return frames.with_dimensions(frames.features(drawn, cfg), p)


def monthly_trend(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return charts.monthly_trend(p, cfg)


def vintage_curves(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return frames.vintage_curves(p, cfg)


def roll_rates(p: Portfolio) -> DataFrame:
    return frames.roll_matrix_long(p)


SEGMENT_KEYS = ("region", "income_band", "product_type", "util_band")


def segment_measures(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """Measures per region, income, product and band, observed groups only.

    Statements are reduced to one row per card and band before the join, which
    also makes the count of distinct cards a count of rows.
    """
    per_card = (
        frames.features(p.statements, cfg)
        .where(F.col("util_band").isNotNull())
        .groupBy("card_id", "util_band")
        .agg(
            rows().alias("n"),
            F.sum(F.rint(F.col("utilization") * 10_000).cast("bigint")).alias("util_units"),
            F.sum("is_delinquent").alias("n30"),
            F.sum("is_default").alias("n90"),
            total("statement_balance").alias("balance"),
        )
    )
    return (
        frames.with_dimensions(per_card, p)
        .dropna(subset=list(SEGMENT_KEYS))
        .groupBy(*SEGMENT_KEYS)
        .agg(
            rows().alias("accounts"),
            (ratio(F.sum("util_units"), F.sum("n")) / 10_000.0).alias("avg_util"),
            ratio(F.sum("n30"), F.sum("n")).alias("del_rate"),
            ratio(F.sum("n90"), F.sum("n")).alias("def_rate"),
            F.sum("balance").alias("exposure"),
        )
    )


def segments(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    return segment_measures(p, cfg).orderBy(*SEGMENT_KEYS)


def expected_loss(p: Portfolio, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    people = p.accounts.withColumnRenamed("card_limit", "credit_limit")
    return frames.expected_loss(p, cfg).join(people, "card_id")


EXPORTS = {
    "T1_portfolio_overview": portfolio,
    "T2_monthly_trend": monthly_trend,
    "T3_vintage_curves": vintage_curves,
    "T4_roll_rate_matrix": roll_rates,
    "T5_utilization_segments": segments,
    "T6_expected_loss": expected_loss,
}


def write_all(p: Portfolio, folder: str) -> dict[str, int]:
    """Write the six exports as CSV folders below ``folder``, all or none, and give their numbers of rows.

    They are written beside first and moved when all are whole; a manifest with rows and
    files, published last, makes them valid. If the manifest says that the same stored version was
    exported and its files are still there, nothing is written.
    """
    spark, folder = p.statements.sparkSession, folder.rstrip("/")
    held = exported(spark, folder)
    if held and p.version is not None and held["version"] == p.version:
        return held["rows"]
    staged = f"{folder}/.staged-{uuid.uuid4().hex}"

    def write(item) -> tuple[str, int]:
        seen = Observation(f"{item[0]}-{uuid.uuid4().hex}")
        write_csv(item[1](p).observe(seen, rows().alias("rows")), f"{staged}/{item[0]}")
        return item[0], int(seen.get["rows"])

    try:
        with ThreadPoolExecutor(len(EXPORTS)) as pool:
            counts = dict(pool.map(write, EXPORTS.items()))
        files.remove(spark, f"{folder}/{MANIFEST}")
        for name in EXPORTS:
            files.remove(spark, f"{folder}/{name}")
            files.move(spark, f"{staged}/{name}", f"{folder}/{name}")
    finally:
        files.remove(spark, staged)
    listed = {name: files.listing(spark, f"{folder}/{name}") for name in EXPORTS}
    files.publish(spark, f"{folder}/{MANIFEST}", json.dumps({"version": p.version, "rows": counts, "files": listed}, indent=1), replace=True)
    return counts


def exported(spark: SparkSession, folder: str) -> dict | None:
    """The manifest of the exports in a folder, or None if they are missing, unfinished or changed."""
    folder = folder.rstrip("/")
    if not files.exists(spark, f"{folder}/{MANIFEST}"):
        return None
    held = json.loads(files.read(spark, f"{folder}/{MANIFEST}"))
    for name, listed in held["files"].items():
        if not files.exists(spark, f"{folder}/{name}"):
            return None
        if [f[:2] for f in files.listing(spark, f"{folder}/{name}")] != [tuple(f[:2]) for f in listed]:
            return None
    return held


def export_files(p: Portfolio, folder: str) -> DataFrame:
    """(export, rows): the six exports as written below ``folder``, counted by reading their files back."""
    spark = p.statements.sparkSession
    counts = write_all(p, folder)
    read = {name: spark.read.option("header", True).csv(f"{folder.rstrip('/')}/{name}") for name in counts}
    parts = [df.agg(rows().alias("rows")).select(F.lit(name).alias("export"), "rows") for name, df in read.items()]
    return reduce(DataFrame.unionByName, parts)


def final_summary(p: Portfolio, auc: DataFrame | None = None, cfg: RiskConfig = DEFAULTS) -> DataFrame:
    """One row with the headline figures; ``auc`` adds the model's one-row score.

    All risk figures come from one pass over the card-level losses: every
    statement of the last month belongs to a card with a score.
    """
    stage = lambda i: F.count_if(F.col("ifrs9_stage") == f"Stage {i}")
    risk = (
        frames.expected_loss(p, cfg)
        .agg(
            ratio(F.count_if(F.col("max_dpd") >= cfg.default_dpd), rows()).alias("portfolio_pd"),
            F.max("lgd").alias("portfolio_lgd"),
            F.sum("ead").alias("portfolio_ead"),
            frames.cents("expected_loss").alias("expected_loss"),
            *[stage(i).alias(f"stage_{i}_accounts") for i in (1, 2, 3)],
        )
        .withColumn("el_rate", ratio("expected_loss", "portfolio_ead"))
    )
    count = lambda df: df.select(rows().alias("n")).scalar()
    months = lambda pick: p.statements.select(pick("period_month").alias("m")).scalar()
    columns = {
        "customers": count(p.customers),
        "cards": count(p.cards),
        "statements": count(p.statements),
        "writeoffs": count(p.writeoffs),
        "min_month": months(F.min),
        "max_month": months(F.max),
    }
    if auc is not None:
        columns["roc_auc"] = auc.scalar()
    return risk.withColumns(columns)
