"""Typed readers and the CSV writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revolva.plans.portfolio import Portfolio
from revolva.sources.schemas import TABLES


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Read one portfolio table from CSV with a header.

    The schema is declared, never inferred, and a malformed row stops the read.
    """
    return (
        spark.read.schema(TABLES[table])
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("dateFormat", "yyyy-MM-dd")
        .csv(path)
    )


def read_parquet(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Read one portfolio table from Parquet and cast it to the declared types."""
    schema = TABLES[table]
    return spark.read.parquet(path).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


class RepeatedStatements(ValueError):
    """The panel holds more than one statement for some card and month."""


def check_panel(statements: DataFrame) -> None:
    """Refuse a panel with repeated (card, month) keys.

    Ordered operators need the key to be unique. It also bounds their window
    groups by the number of calendar months, however large the portfolio is.
    Counts combine before the shuffle, so the check itself cannot be skewed.
    """
    keys = ["card_id", "period_month"]
    repeated = statements.groupBy(*keys).count().where(F.col("count") > 1).agg(F.count(F.lit(1))).first()[0]
    if repeated:
        raise RepeatedStatements(f"{repeated} repeated (card_id, period_month) keys")


def read_portfolio(spark: SparkSession, folder: str, fmt: str = "csv", check: bool = True) -> Portfolio:
    """Read ``customers``, ``cards``, ``statements`` and ``writeoffs`` from a folder.

    With ``check=False`` the portfolio may only be given to the quality checks,
    which are meant for data that breaks the rules.
    """
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unsupported format: {fmt}")
    reader = read_csv if fmt == "csv" else read_parquet
    p = Portfolio(**{t: reader(spark, f"{folder.rstrip('/')}/{t}.{fmt}", t) for t in TABLES})
    if check:
        check_panel(p.statements)
    return p


def write_csv(df: DataFrame, path: str) -> None:
    """Write an export as CSV part files with a header, one per task."""
    df.write.mode("error").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("error").parquet(path)
