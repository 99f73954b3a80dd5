"""Row counts, date range and missing cells of the loaded tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revolva.functions.numeric import rows
from revolva.plans.portfolio import Portfolio

TABLE_NAMES = ("customers", "cards", "statements", "writeoffs")


def _per_table(p: Portfolio, summarize) -> DataFrame:
    frames = []
    for name in TABLE_NAMES:
        frames.append(summarize(getattr(p, name)).select(F.lit(name).alias("tbl"), "*"))
    return reduce(DataFrame.unionByName, frames)


def row_counts(p: Portfolio) -> DataFrame:
    return _per_table(p, lambda df: df.agg(rows().alias("rows")))


def date_range(p: Portfolio) -> DataFrame:
    return p.statements.agg(F.min("period_month").alias("min_month"), F.max("period_month").alias("max_month"))


def null_cells(df: DataFrame) -> DataFrame:
    """Missing cells of a table over all its columns."""
    missing = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
    return df.agg(missing.alias("null_cells"))


def null_totals(p: Portfolio) -> DataFrame:
    return _per_table(p, null_cells)
