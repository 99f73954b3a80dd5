"""Deterministic mapping from the order tables to a card portfolio.

A customer becomes a customer with one card; its shipped order lines, folded
into 30 months, become the card's monthly statements: what was kept is the
balance, discounts pay it, taxes delay it, and the account balance sets limit
and punctuality. Only whole numbers are used, so all engines agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revolva.functions.bands import bucket_of

MONTHS = 30
FIRST_SHIP_YEAR = 1995
FIRST_YEAR = 2022
DEFAULT_DPD = 90
WRITEOFF_DPD = 95

# The rules of this mapping; the SQL equivalents state them on their own.
BALANCE_DIVISOR = 3
MIN_DUE_DIVISOR = 40
# The account balance runs from about -1,000 to 10,000: income bands are thirds of that range.
MEDIUM_FROM, HIGH_FROM = 2667, 6333
# Product per market segment, anything else is a business card.
PRODUCT = {
    "BUILDING": "classic",
    "FURNITURE": "classic",
    "MACHINERY": "premium",
    "HOUSEHOLD": "platinum",
}


def _case(column: str, branches: dict[str, str], other: str = "NULL") -> str:
    whens = " ".join(f"WHEN '{label}' THEN {value}" for label, value in branches.items())
    return f"CASE {column} {whens} ELSE {other} END"


def holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: the customer and card columns, and how punctual it pays."""
    root = sf_dir.rstrip("/")
    customer, nation, region = (
        spark.read.parquet(f"{root}/{t}.parquet") for t in ("customer", "nation", "region")
    )
    product = _case("c_mktsegment", {segment: f"'{label}'" for segment, label in PRODUCT.items()}, "'business'")
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .selectExpr(
            "CAST(c_custkey AS BIGINT) AS card_id",
            "r_name AS region",
            f"CASE WHEN c_acctbal < {MEDIUM_FROM} THEN 'low' WHEN c_acctbal < {HIGH_FROM} THEN 'medium' ELSE 'high' END"
            " AS income_band",
            f"{product} AS product_type",
            "CAST(floor(c_acctbal) AS BIGINT) AS worth",
            "CAST(c_nationkey AS BIGINT) AS nation",
        )
        .selectExpr(
            "card_id AS customer_id",
            "region",
            "income_band",
            "CAST(25 + abs(worth) % 40 AS INT) AS age",
            "CAST(1 + nation % 12 AS INT) AS tenure_years",
            "card_id",
            "product_type",
            "CAST(1000 * (15 + (worth + 1000) DIV 150) AS INT) AS credit_limit",
            f"CASE WHEN worth < 0 THEN 0 WHEN worth < {MEDIUM_FROM} THEN 13 WHEN worth < {HIGH_FROM} THEN 18 ELSE 24 END AS punctual",
        )
    )


def customers(people: DataFrame) -> DataFrame:
    return people.select("customer_id", "region", "income_band", "age", "tenure_years")


def cards(people: DataFrame) -> DataFrame:
    return people.select("card_id", "customer_id", "product_type", "credit_limit")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped lines per customer and folded month.

    The lines are shuffled once, by their order, and looked up in their share of the orders,
    so they are not sorted; a hot order is a skewed join that can be split, as its group is
    formed after it. A customer that owns a large share of all lines is one row per month and
    task in the second shuffle.
    """
    root = sf_dir.rstrip("/")
    lines = spark.read.parquet(f"{root}/lineitem.parquet").selectExpr(
        "l_orderkey",
        f"((year(l_shipdate) - {FIRST_SHIP_YEAR}) * 12 + month(l_shipdate) - 1) % {MONTHS} AS idx",
        "CAST(floor(l_extendedprice) AS BIGINT) AS price",
        "l_returnflag = 'R' AS returned",
        "CAST(round(l_discount * 100) AS INT) AS discount",
        "CAST(round(l_tax * 100) AS INT) AS tax",
    )
    orders = spark.read.parquet(f"{root}/orders.parquet").select("o_orderkey", "o_custkey")
    return (
        lines.join(orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").cast("bigint").alias("card_id"), "idx")
        .agg(
            F.sum("price").alias("gross"),
            F.sum(F.when(F.col("returned"), 0).otherwise(F.col("price"))).alias("net"),
            F.max("discount").alias("discount"),
            F.max("tax").alias("tax"),
        )
    )


def statements(people: DataFrame, act: DataFrame) -> DataFrame:
    """Balance from the price kept, payment from the discount, days past due from tax and account.

    The cards of a bucket are far fewer than its months: they are hashed and the months are not sorted.
    """
    return (
        act.join(people.select("card_id", "credit_limit", "punctual").hint("shuffle_hash"), "card_id")
        .selectExpr(
            "*",
            f"coalesce(net, 0) DIV {BALANCE_DIVISOR} AS balance",
            "5 * greatest(0, 4 * tax - 2 * discount - punctual) AS dpd",
            "greatest(0, 12 * discount - 4 * tax - 10) AS paid_percent",
        )
        .select(
            "card_id",
            F.expr(f"add_months(make_date({FIRST_YEAR}, 1, 1), idx)").alias("period_month"),
            F.expr("CAST(balance AS INT)").alias("statement_balance"),
            F.expr(f"CAST(balance DIV {MIN_DUE_DIVISOR} AS INT)").alias("min_due"),
            F.expr("CAST(balance * paid_percent DIV 100 AS INT)").alias("paid_amount"),
            F.expr("CAST(dpd AS INT)").alias("days_past_due"),
            bucket_of("dpd").alias("dpd_bucket"),
            "credit_limit",
            F.expr("CAST(gross DIV 10 AS INT)").alias("transaction_amount"),
        )
    )


def writeoffs(stmts: DataFrame) -> DataFrame:
    """Cards well beyond default, half a year after it, at their largest balance.

    Half of the share that it has paid of all its balances is recovered.
    """
    return (
        stmts.groupBy("card_id")
        .agg(
            F.max("days_past_due").alias("worst"),
            F.max("statement_balance").alias("amount"),
            F.sum(F.col("paid_amount").cast("bigint")).alias("paid"),
            F.sum(F.col("statement_balance").cast("bigint")).alias("owed"),
            F.min(F.when(F.col("days_past_due") >= DEFAULT_DPD, F.col("period_month"))).alias("defaulted"),
        )
        .where(f"worst >= {WRITEOFF_DPD} AND amount > 0")
        .selectExpr(
            "card_id",
            "amount AS writeoff_amount",
            "CAST(least(amount, amount * paid DIV (2 * owed)) AS INT) AS recovery_amount",
            "add_months(defaulted, 6) AS writeoff_date",
        )
    )
