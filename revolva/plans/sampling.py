"""Exact-size uniform samples and splits that do not depend on partitioning.

Rows are ordered by a hash of their key and a seed. The hash is MD5, which any
SQL engine can reproduce.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revolva.functions import windows

# Hexadecimal digits of a level: a histogram has at most 4,096 rows at any data size.
_DIGITS = 3


def draw(seed: int, *keys: str) -> Column:
    parts = [F.lit(str(seed))] + [F.col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def _cut(df: DataFrame, prefix: str, left: Column) -> Column:
    """(end, left): the last prefix that ``left`` rows reach into, and how many of its rows."""
    counts = df.groupBy(prefix).agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(windows.before_now(windows.all_groups().orderBy(prefix)))
    return (
        counts.select(prefix, F.coalesce(earlier, F.lit(0)).alias("_before"))
        .where(F.col("_before") < left)
        .select(F.struct(F.max(prefix).alias("end"), (left - F.max("_before")).alias("left")).alias("cut"))
        .scalar()
    )


def sample_share(df: DataFrame, share: float, seed: int, *keys: str) -> DataFrame:
    """Exactly that share of the rows, rounded down."""
    size = df.select(F.floor(F.count(F.lit(1)) * F.lit(share)).alias("n")).scalar()
    return sample_exact(df, size, seed, *keys)


def sample_exact(df: DataFrame, size: int | Column, seed: int, *keys: str) -> DataFrame:
    """The ``size`` rows with the smallest draw; all rows of a smaller frame.

    ``keys`` must be unique. A histogram of draw prefixes finds the prefix in which
    the sample ends, a second one refines it. Rows before are in, rows after are
    out, and only the rows of the last prefix, one in 16 million, are ranked.
    """
    tagged = df.withColumn("_draw", draw(seed, *keys))
    tagged = tagged.withColumns(
        {"_first": F.substring("_draw", 1, _DIGITS), "_second": F.substring("_draw", _DIGITS + 1, _DIGITS)}
    )
    first = _cut(tagged, "_first", F.lit(size) if isinstance(size, int) else size)
    last = tagged.where(F.col("_first") == first.getField("end"))
    second = _cut(last, "_second", first.getField("left"))
    whole = (F.col("_first") < first.getField("end")) | (
        (F.col("_first") == first.getField("end")) & (F.col("_second") < second.getField("end"))
    )
    rank = F.row_number().over(Window.partitionBy("_second").orderBy("_draw", *keys))
    border = (
        last.where(F.col("_second") == second.getField("end"))
        .withColumn("_rank", rank)
        .where(F.col("_rank") <= second.getField("left"))
        .drop("_rank")
    )
    return tagged.where(whole).unionByName(border).drop("_draw", "_first", "_second")
