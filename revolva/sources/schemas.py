"""Declared schemas of the four portfolio tables.

Identifiers are 64-bit so that a portfolio may exceed two billion cards.
Keys and NOT NULL rules are not enforced here; ``operators.quality`` checks them.
"""

from __future__ import annotations

from pyspark.sql import types as T

CUSTOMERS = T.StructType(
    [
        T.StructField("customer_id", T.LongType()),
        T.StructField("region", T.StringType()),
        T.StructField("income_band", T.StringType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("tenure_years", T.IntegerType()),
    ]
)

CARDS = T.StructType(
    [
        T.StructField("card_id", T.LongType()),
        T.StructField("customer_id", T.LongType()),
        T.StructField("product_type", T.StringType()),
        T.StructField("credit_limit", T.IntegerType()),
    ]
)

STATEMENTS = T.StructType(
    [
        T.StructField("card_id", T.LongType()),
        T.StructField("period_month", T.DateType()),
        T.StructField("statement_balance", T.IntegerType()),
        T.StructField("min_due", T.IntegerType()),
        T.StructField("paid_amount", T.IntegerType()),
        T.StructField("days_past_due", T.IntegerType()),
        T.StructField("dpd_bucket", T.StringType()),
        T.StructField("credit_limit", T.IntegerType()),
        T.StructField("transaction_amount", T.IntegerType()),
    ]
)

WRITEOFFS = T.StructType(
    [
        T.StructField("card_id", T.LongType()),
        T.StructField("writeoff_amount", T.IntegerType()),
        T.StructField("recovery_amount", T.IntegerType()),
        T.StructField("writeoff_date", T.DateType()),
    ]
)

TABLES = {
    "customers": CUSTOMERS,
    "cards": CARDS,
    "statements": STATEMENTS,
    "writeoffs": WRITEOFFS,
}

# Column that clusters each table when it is stored.
CLUSTER_KEY = {
    "customers": "customer_id",
    "cards": "card_id",
    "statements": "card_id",
    "writeoffs": "card_id",
    "holders": "card_id",
}
