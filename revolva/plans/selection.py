"""Exact global cuts (quantile borders, stratified shares) without sorting or ranking all rows.

The sort key of a row is written as hexadecimal text of one length that sorts like the key.
To find the rows at some ranks, their keys are narrowed down by histograms: a step counts,
for each beginning that still holds a wanted rank, its continuations by ``DIGITS`` digits, and
running counts tell which continuation holds the rank. Digits that all keys of a
continuation share are skipped. After ``STEPS`` steps the rows that share a beginning have 80
differing bits in common; these few are ranked. A row is then placed by comparing its key
with the cuts, of which there are a few.

All steps read one shuffle of the keys, which Spark reuses. A histogram has at most
16**DIGITS rows for each wanted rank, at any number of rows and however many are tied: the
keys are total orders, so tied rows differ in their later digits. Nothing runs before the
result is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revolva.functions.numeric import canonical, col

#: Hexadecimal digits of a step, and the number of steps.
DIGITS = 5
STEPS = 4
_HEX = "0123456789ABCDEF"


def _down(text: Column, descending: bool) -> Column:
    return F.translate(text, _HEX, _HEX[::-1]) if descending else text


def _bits(c: Column) -> Column:
    """A 64-bit whole number as 16 digits, negative ones first."""
    return F.lpad(F.hex(c.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))), 16, "0")


def _nulls_last(text: Column, digits: int) -> Column:
    return F.coalesce(F.concat(F.lit("0"), text), F.lit("1" + "0" * digits))


def whole(c: Column | str, descending: bool = False) -> Column:
    """A 64-bit whole number as a part of a sort key; nulls last."""
    return _nulls_last(_down(_bits(col(c)), descending), 16)


def amount(c: Column | str, descending: bool = False) -> Column:
    """A number at ten decimals as a part of a sort key; nulls last."""
    value = canonical(c)
    units = F.floor(value)
    rest = F.lpad(F.hex(((value - units) * 10**10).cast("bigint")), 9, "0")
    return _nulls_last(_down(F.concat(_bits(units), rest), descending), 25)


# What ``low`` and ``high`` begin with, and the wanted ranks within a continuation.
_SHARED = """
    substring(low, 1, coalesce(
        nullif(array_position(zip_with(split(low, ''), split(high, ''), (a, b) -> a <> b), true), 0) - 1, length(low)
    )) AS stem
"""
_LEFT = "filter(transform(wanted, r -> r - before), r -> r >= 0 AND r < n) AS wanted"
_BEFORE = "coalesce(sum(n) OVER (PARTITION BY grp, stem ORDER BY next ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before"


def cuts(keys: DataFrame, ranks: Callable[[Column], Column]) -> DataFrame:
    """(grp, cuts): the keys at some 0-based ranks of each group, in order.

    ``keys`` is (grp, key); ``ranks`` gives an array of ranks for a number of rows, of which
    those beyond the last row are left out. Groups and ranks must be few. The keys of a
    group must differ.
    """
    spread = keys.repartition("key")
    bounds = [F.expr(x) for x in ("count(*) AS n", "min(key) AS low", "max(key) AS high")]
    inside = F.filter(ranks(F.col("n")), lambda r: r < F.col("n"))
    open_ = spread.groupBy("grp").agg(*bounds).select("grp", F.expr(_SHARED), inside.alias("wanted"))
    for _ in range(STEPS):
        # One row for each beginning with a wanted rank: at most as many as ranks.
        held = spread.join(F.broadcast(open_), "grp").where("startswith(key, stem)")
        continued = F.expr(f"substring(key, length(stem) + 1, {DIGITS}) AS next")
        counted = held.groupBy("grp", "stem", continued).agg(*bounds, F.expr("first(wanted) AS wanted"))
        open_ = counted.selectExpr("*", _BEFORE).selectExpr("grp", _SHARED, _LEFT).where("size(wanted) > 0")
    last = spread.join(F.broadcast(open_), "grp").where("startswith(key, stem)")
    ranked = last.selectExpr("*", "row_number() OVER (PARTITION BY grp, stem ORDER BY key) - 1 AS place")
    at = ranked.where("array_contains(wanted, place)")
    return at.groupBy("grp").agg(F.expr("array_sort(collect_list(key)) AS cuts"))


def _reached(found: DataFrame, count: int) -> tuple[Column, Callable[[Column, Column], Column]]:
    """The cuts of all groups as one value, and how many of its group's a key has reached."""
    by_group = found.select(F.map_from_entries(F.collect_list(F.struct("grp", "cuts")))).scalar()

    def reached(grp: Column, key: Column) -> Column:
        mine = F.try_element_at("_cuts", grp)
        # Without a higher-order function, in which a scalar subquery may not stand.
        return sum((F.coalesce((key >= F.get(mine, F.lit(i))).cast("int"), F.lit(0)) for i in range(count)), F.lit(0))

    return by_group, reached


def with_ntiles(df: DataFrame, tiles: int, **orders: Sequence[Column]) -> DataFrame:
    """NTILE over the whole frame, one for each of ``orders``: total orders, as parts of a sort key.

    The first ``count % tiles`` tiles hold one row more. All orders are cut in the same steps.
    """

    def first_ranks(n: Column) -> Column:
        small, large = F.floor(n / tiles), n % tiles
        return F.transform(F.sequence(F.lit(1), F.lit(tiles - 1)), lambda t: t * small + F.least(t, large))

    keyed = df.withColumns({f"_key_{name}": F.concat(*order) for name, order in orders.items()})
    entries = [F.struct(F.lit(name).alias("grp"), F.col(f"_key_{name}").alias("key")) for name in orders]
    by_group, reached = _reached(cuts(keyed.select(F.inline(F.array(*entries))), first_ranks), tiles - 1)
    placed = keyed.withColumn("_cuts", by_group)
    placed = placed.withColumns({name: reached(F.lit(name), F.col(f"_key_{name}")) + 1 for name in orders})
    return placed.drop("_cuts", *[f"_key_{name}" for name in orders])


def with_first_share(df: DataFrame, order: Sequence[Column], share: float, name: str, group: Column) -> DataFrame:
    """Whether a row is among the first ``share`` of its group, rounded up, in a total order.

    ``group`` has few values, none of them null.
    """
    keyed = df.withColumns({"_grp": group.cast("string"), "_key": F.concat(*order)})
    found = cuts(keyed.select(F.col("_grp").alias("grp"), F.col("_key").alias("key")), lambda n: F.array(F.ceil(n * share)))
    by_group, reached = _reached(found, 1)
    placed = keyed.withColumn("_cuts", by_group).withColumn(name, reached(F.col("_grp"), F.col("_key")) == 0)
    return placed.drop("_grp", "_key", "_cuts")
