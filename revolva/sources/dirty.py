"""A deterministic overlay that plants data-quality faults in a portfolio."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revolva.plans.portfolio import Portfolio

ORPHAN_SHIFT = 1_000_000


def _null_if(condition: Column, c: Column | str) -> Column:
    return F.when(~condition, F.col(c) if isinstance(c, str) else c)


def with_faults(p: Portfolio) -> Portfolio:
    k = F.col("customer_id")
    people = p.customers.select(
        "customer_id",
        _null_if(k % 107 == 0, "region").alias("region"),
        _null_if(k % 131 == 0, "income_band").alias("income_band"),
        "age",
        "tenure_years",
    )
    people = people.unionByName(p.customers.where(k % 137 == 0))

    k = F.col("card_id")
    plastic = p.cards.select(
        "card_id",
        F.when(k % 101 == 0, F.col("customer_id") + ORPHAN_SHIFT)
        .when(k % 109 == 0, None)
        .otherwise(F.col("customer_id"))
        .alias("customer_id"),
        "product_type",
        F.when(k % 103 == 0, 0).when(k % 113 == 0, None).otherwise(F.col("credit_limit")).alias("credit_limit"),
    ).unionByName(p.cards.where(k % 127 == 0))

    month = F.col("period_month")
    z = k * 31 + (F.year(month) - 2022) * 12 + F.month(month) - 1
    balance = F.col("statement_balance")
    panel = p.statements.select(
        F.when(z % 199 == 0, k + ORPHAN_SHIFT).otherwise(k).alias("card_id"),
        "period_month",
        F.when(z % 211 == 0, -balance - 1).when(z % 241 == 0, None).otherwise(balance).alias("statement_balance"),
        "min_due",
        _null_if(z % 229 == 0, "paid_amount").alias("paid_amount"),
        F.when(z % 223 == 0, -5)
        .when(z % 233 == 0, None)
        .otherwise(F.col("days_past_due"))
        .alias("days_past_due"),
        F.when(z % 227 == 0, "1-29").otherwise(F.col("dpd_bucket")).alias("dpd_bucket"),
        _null_if(z % 239 == 0, "credit_limit").alias("credit_limit"),
        "transaction_amount",
    ).unionByName(p.statements.where(z % 251 == 0))

    amount = F.when(k % 11 == 0, 0).otherwise(F.col("writeoff_amount"))
    losses = p.writeoffs.select(
        F.when(k % 7 == 0, k + ORPHAN_SHIFT).otherwise(k).alias("card_id"),
        amount.alias("writeoff_amount"),
        F.when(k % 13 == 0, amount + 1).otherwise(F.col("recovery_amount")).alias("recovery_amount"),
        "writeoff_date",
    )
    return Portfolio(people, plastic, panel, losses)
