from pyspark.sql import functions as F

from revolva.functions import bands, numeric


def values(spark, data, schema, expr):
    return [r[0] for r in spark.createDataFrame(data, schema).select(expr).collect()]


def test_buckets_at_their_edges(spark):
    dpd = [0, 1, 29, 30, 59, 60, 89, 90, 400, -1, None]
    got = values(spark, [(d,) for d in dpd], "d int", bands.bucket_of("d"))
    assert got == ["0", "1-29", "1-29", "30-59", "30-59", "60-89", "60-89", "90+", "90+", None, None]


def test_severity_is_null_for_unknown_labels(spark):
    labels = [(b,) for b in bands.BUCKETS] + [("other",), (None,)]
    assert values(spark, labels, "b string", bands.severity("b")) == [1, 2, 3, 4, 5, None, None]


def test_bands_close_on_opposite_sides(spark):
    data = [(u,) for u in (0.0, 0.4, 0.7, 0.9, 1.2, None)]
    left = values(spark, data, "u double", bands.util_band(F.col("u")))
    right = values(spark, data, "u double", bands.util_band_right_closed(F.col("u")))
    low, medium, high, critical = bands.UTIL_BANDS
    assert left == [low, medium, high, critical, critical, low]
    assert right == [low, low, medium, high, critical, None]


def test_payment_type_takes_the_first_match(spark):
    data = [(100, 30, 100), (100, 30, 30), (100, 30, 1), (100, 30, 0), (0, 0, 0)]
    got = values(spark, data, "statement_balance int, min_due int, paid_amount int", bands.payment_type())
    assert got == ["Full Payment", "Min Payment", "Partial Payment", "No Payment", "Full Payment"]


def test_two_ways_to_round(spark):
    data = [(0.5,), (1.5,), (2.5,), (-2.5,)]
    assert values(spark, data, "x double", numeric.fixed("x", 0)) == [1.0, 2.0, 3.0, -3.0]
    assert values(spark, data, "x double", numeric.half_even("x", 0)) == [0.0, 2.0, 2.0, -2.0]


def test_rounding_ignores_summation_noise(spark):
    noisy = [(0.1 + 0.2,), (0.3,), (0.12345 - 1e-16,), (0.12345,)]
    assert values(spark, noisy, "x double", numeric.fixed("x", 4)) == [0.3, 0.3, 0.1235, 0.1235]


def test_zero_denominator_is_null(spark):
    data = [(1, 2), (1, 0), (None, 2)]
    assert values(spark, data, "a int, b int", numeric.ratio("a", "b")) == [0.5, None, None]
    assert values(spark, data, "a int, b int", numeric.percent("a", "b")) == [50.0, None, None]


def test_months_between_crosses_years(spark):
    data = [("2022-11-01", "2024-02-01")]
    expr = bands.months_between(F.col("b").cast("date"), F.col("a").cast("date"))
    assert values(spark, data, "a string, b string", expr) == [15]
