"""Data-quality checks: missing values, duplicates, ranges, references, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revolva.functions import windows
from revolva.functions.bands import lgd, severity
from revolva.functions.numeric import fixed, percent, rows, total
from revolva.operators.checks import CARD_ISSUES, ROW_CHECKS, STATEMENT_ISSUES, WRITEOFF_ISSUES
from revolva.plans.portfolio import Portfolio


def _null_counts(df: DataFrame, label: str, columns: dict[str, str]) -> DataFrame:
    counts = [F.count_if(F.col(c).isNull()).alias(f"null_{name}") for name, c in columns.items()]
    return df.agg(*counts).select(F.lit(f"{label} - null check").alias("check_name"), "*")


def null_customers(p: Portfolio) -> DataFrame:
    return _null_counts(
        p.customers,
        "customers",
        {"customer_id": "customer_id", "region": "region", "income_band": "income_band"},
    )


def null_cards(p: Portfolio) -> DataFrame:
    return _null_counts(
        p.cards,
        "cards",
        {"card_id": "card_id", "customer_id": "customer_id", "credit_limit": "credit_limit"},
    )


def null_statements(p: Portfolio) -> DataFrame:
    return _null_counts(
        p.statements,
        "statements",
        {
            "balance": "statement_balance",
            "paid": "paid_amount",
            "dpd": "days_past_due",
            "limit": "credit_limit",
        },
    )


def _duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(rows().alias("cnt")).where(F.col("cnt") > 1)


def duplicate_customers(p: Portfolio) -> DataFrame:
    return _duplicates(p.customers, "customer_id")


def duplicate_cards(p: Portfolio) -> DataFrame:
    return _duplicates(p.cards, "card_id")


def duplicate_statements(p: Portfolio) -> DataFrame:
    """Repeated (card, month) keys. Ordered panels assume that there are none."""
    return _duplicates(p.statements, "card_id", "period_month")


def issue_counts(df: DataFrame, issues: dict) -> DataFrame:
    """(issue, count) for any number of row conditions, from a single scan."""
    counts = df.agg(*[F.count_if(test()).alias(name) for name, test in issues.items()])
    pairs = [F.struct(F.lit(name).alias("issue"), F.col(name).alias("count")) for name in issues]
    return counts.select(F.inline(F.array(*pairs)))


def battery(p: Portfolio) -> DataFrame:
    """(tbl, issue, count): all row checks of all tables, from a single scan of each."""
    counted = [
        issue_counts(getattr(p, table), tests).select(F.lit(table).alias("tbl"), "*") for table, tests in ROW_CHECKS.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def statement_issue(p: Portfolio, name: str) -> DataFrame:
    return issue_counts(p.statements, {name: STATEMENT_ISSUES[name]})


def card_issue(p: Portfolio, name: str) -> DataFrame:
    return issue_counts(p.cards, {name: CARD_ISSUES[name]})


def writeoff_issue(p: Portfolio, name: str) -> DataFrame:
    return issue_counts(p.writeoffs, {name: WRITEOFF_ISSUES[name]})


def _orphans(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Child rows without a parent. Children are counted per key before the join,

    so a key shared by very many rows, NULL included, reaches it as one row.
    """
    lost = child.groupBy(key).agg(rows().alias("n")).join(parent.select(key), key, "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count")).select(F.lit(name).alias("issue"), "count")


def orphan_cards(p: Portfolio) -> DataFrame:
    return _orphans(p.cards, p.customers, "customer_id", "orphan_cards")


def orphan_statements(p: Portfolio) -> DataFrame:
    return _orphans(p.statements, p.cards, "card_id", "orphan_statements")


def orphan_writeoffs(p: Portfolio) -> DataFrame:
    return _orphans(p.writeoffs, p.cards, "card_id", "orphan_writeoffs")


def profile_customers(p: Portfolio) -> DataFrame:
    groups = p.customers.groupBy("region", "income_band").agg(rows().alias("customers"))
    return groups.withColumn("pct", percent("customers", F.sum("customers").over(windows.all_groups()))).orderBy(
        F.desc("customers"), "region", "income_band"
    )


def profile_products(p: Portfolio) -> DataFrame:
    return (
        p.cards.groupBy("product_type")
        .agg(
            rows().alias("cards"),
            fixed(F.avg("credit_limit"), 0).alias("avg_limit"),
            F.min("credit_limit").alias("min_limit"),
            F.max("credit_limit").alias("max_limit"),
        )
        .orderBy(F.desc("cards"), "product_type")
    )


def profile_buckets(p: Portfolio) -> DataFrame:
    groups = p.statements.groupBy("dpd_bucket").agg(
        rows().alias("account_months"), total("statement_balance").alias("total_exposure")
    )
    return groups.select(
        "dpd_bucket",
        "account_months",
        percent("account_months", F.sum("account_months").over(windows.all_groups())).alias("pct"),
        "total_exposure",
    ).orderBy(severity("dpd_bucket"))


def monthly_completeness(p: Portfolio) -> DataFrame:
    return (
        p.statements.groupBy("period_month")
        .agg(rows().alias("statements"), F.count_distinct("card_id").alias("unique_cards"))
        .orderBy("period_month")
    )


def lgd_range(p: Portfolio) -> DataFrame:
    """Extremes and mean of the loss share; digits beyond ten are noise of the sum."""
    return p.writeoffs.agg(
        fixed(F.min(lgd()), 10).alias("min_lgd"),
        fixed(F.max(lgd()), 10).alias("max_lgd"),
        fixed(F.avg(lgd()), 10).alias("avg_lgd"),
    )
