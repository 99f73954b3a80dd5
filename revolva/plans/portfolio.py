"""The four tables of a portfolio, handed to every operator."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Portfolio:
    customers: DataFrame
    cards: DataFrame
    statements: DataFrame
    writeoffs: DataFrame
    stored_holders: DataFrame | None = None
    # Known for a stored portfolio, whose statements are partitioned by month.
    last_month: date | None = None
    # Names the stored rows: equal versions hold equal rows.
    version: str | None = None

    @property
    def holders(self) -> DataFrame:
        """Every card with its customer's columns, NULL where it has no customer.

        The two dimensions are joined to each other first, so that a fact table
        is shuffled for one join on ``card_id`` instead of for two. A stored
        portfolio keeps the result, clustered like the statements.
        """
        if self.stored_holders is not None:
            return self.stored_holders
        return (
            self.cards.withColumnRenamed("credit_limit", "card_limit")
            .join(self.customers.withColumn("has_customer", F.lit(True)), "customer_id", "left")
            .withColumn("has_customer", F.coalesce("has_customer", F.lit(False)))
        )

    @property
    def accounts(self) -> DataFrame:
        """The cards that have a customer."""
        return self.holders.where("has_customer").drop("has_customer")

    def latest_month(self) -> Column:
        """The last month with a statement: known, or an uncorrelated scalar subquery."""
        if self.last_month is not None:
            return F.lit(self.last_month)
        return self.statements.select(F.max("period_month").alias("latest")).scalar()

    def latest_statements(self) -> DataFrame:
        return self.statements.where(F.col("period_month") == self.latest_month())

    def create_views(self) -> None:
        """Register the tables and the six feature views for SQL users."""
        from revolva.operators import features

        for name in ("customers", "cards", "statements", "writeoffs"):
            getattr(self, name).createOrReplaceTempView(name)
        for name, build in features.VIEWS.items():
            build(self).createOrReplaceTempView(name)
