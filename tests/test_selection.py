import random

import pytest
from panels import statement
from pyspark.sql import Window
from pyspark.sql import functions as F

from revolva.plans import sampling, selection


def order():
    return [selection.amount("score", descending=True), selection.whole("card_id")]


def by_score():
    return [F.desc_nulls_last(F.col("score").cast("decimal(28,10)")), F.col("card_id")]


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[0])


@pytest.mark.parametrize("size", [1, 3, 5, 7, 10, 101, 1000])
@pytest.mark.parametrize("tiles", [5, 10])
def test_tiles_equal_ntile(spark, size, tiles):
    rng = random.Random(size)
    data = [(i, None if rng.random() < 0.1 else float(rng.randrange(5))) for i in range(size)]
    df = spark.createDataFrame(data, "card_id long, score double").repartition(4)
    want = df.withColumn("t", F.ntile(tiles).over(Window.orderBy(*by_score())))
    assert as_rows(selection.with_ntiles(df, tiles, t=order())) == as_rows(want)


@pytest.fixture(scope="module")
def tied(spark):
    """A third of all cards share a score; the rest differ in sign, size and last decimals, some have none."""
    rng = random.Random(1)
    draw = lambda i: 0.5 if i % 3 == 0 else None if i % 17 == 0 else rng.uniform(-5, 5) * 10 ** rng.randrange(-9, 8)
    data = [(rng.randrange(-(2**62), 2**62), draw(i), i % 31) for i in range(6000)]
    return spark.createDataFrame(data, "card_id long, score double, months int").repartition(7).checkpoint()


def test_a_tie_of_a_third_of_all_cards(tied):
    by_months = [F.desc_nulls_last("months"), F.col("card_id")]
    want = tied.withColumns(
        {"a": F.ntile(10).over(Window.orderBy(*by_score())), "b": F.ntile(10).over(Window.orderBy(*by_months))}
    )
    months = [selection.whole("months", descending=True), selection.whole("card_id")]
    assert as_rows(selection.with_ntiles(tied, 10, a=order(), b=months)) == as_rows(want)


def test_rising_orders_and_extreme_numbers(spark):
    numbers = [-(2**63), -(2**40), -1, 0, 1, 9, 10, 2**40, 2**63 - 1, None]
    amounts = [-12345678.5, -0.0000000001, 0.0, 0.0000000001, 99999.9999999999, 123456789.25, None]
    data = [(i, n, a) for i, (n, a) in enumerate((n, a) for n in numbers for a in amounts)]
    df = spark.createDataFrame(data, "id long, n long, a double")
    for part, column in ((selection.whole, "n"), (selection.amount, "a")):
        for down in (False, True):
            text = df.select("id", part(column, descending=down).alias("t"), F.col(column).alias("v"))
            falling = (lambda v: -v) if down else (lambda v: v)
            want = sorted((r.v is None, falling(r.v or 0), r.id) for r in text.collect())
            got = sorted((r.t, r.id) for r in text.collect())
            assert [i for _, i in got] == [i for _, _, i in want]


def test_what_the_steps_leave_is_still_ranked(tied, monkeypatch):
    monkeypatch.setattr(selection, "STEPS", 1)
    monkeypatch.setattr(selection, "DIGITS", 2)
    want = tied.withColumn("a", F.ntile(10).over(Window.orderBy(*by_score())))
    assert as_rows(selection.with_ntiles(tied, 10, a=order())) == as_rows(want)


def test_histograms_leave_few_rows_to_rank(tied, monkeypatch):
    """The rows that share a beginning with a cut after all steps, though a third of them are tied."""
    keys = tied.select(F.lit("").alias("grp"), F.concat(*order()).alias("key"))
    cut = selection.cuts(keys, lambda n: F.array(F.floor(n / 2), F.floor(n / 3), F.floor(n / 5))).first().cuts
    ordered = sorted(r.key for r in keys.collect())
    assert cut == [ordered[6000 // 5], ordered[6000 // 3], ordered[6000 // 2]]
    monkeypatch.setattr(selection, "STEPS", 4)
    plan = selection.cuts(keys, lambda n: F.array(F.floor(n / 2)))._jdf.queryExecution().toString()
    assert "RangePartitioning" not in plan and "rangepartitioning" not in plan


def test_shares_per_group(spark):
    df = spark.range(301).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"))
    placed = selection.with_first_share(df, [selection.whole("k", descending=True)], 0.25, "first", F.col("g"))
    falling = Window.partitionBy("g").orderBy(F.desc("k"))
    n = F.count("*").over(Window.partitionBy("g"))
    want = F.row_number().over(falling) <= F.ceil(n * 0.25)
    assert placed.withColumn("w", want).where("first <> w").count() == 0
    assert selection.with_first_share(df, [selection.whole("k")], 1.0, "first", F.col("g")).where("NOT first").count() == 0


def test_an_empty_frame(spark):
    df = spark.createDataFrame([], "card_id long, score double")
    assert selection.with_ntiles(df, 10, t=order()).count() == 0


@pytest.fixture(scope="module")
def panel(make):
    return make([statement(c, m) for c in range(40) for m in range(10)]).statements


@pytest.mark.parametrize("size", [1, 57, 399, 400, 1000])
def test_sample_is_exact_and_repeatable(panel, size):
    keys = ("card_id", "period_month")
    draw = lambda df, seed=42: {tuple(r) for r in sampling.sample_exact(df, size, seed, *keys).select(*keys).collect()}
    first = draw(panel)
    assert len(first) == min(size, 400)
    assert draw(panel.repartition(7, "period_month")) == first
    if 1 < size < 399:
        assert draw(panel, seed=7) != first
