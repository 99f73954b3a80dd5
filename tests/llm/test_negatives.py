"""Residue arithmetic against Python's integers, and hard negatives against all pairs."""

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from revolva.llm import negatives, queries
from revolva.llm.negatives import Residues, primes

VECTORS = "vec_id long, embedding array<float>, label int"


def exact(a, b):
    return [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]


@pytest.mark.parametrize("width", [1, 5, 63, 64, 65, 200])
@pytest.mark.parametrize("reach", [1, 300, 40_000, 2**26])
def test_products_are_exact(width, reach):
    rng = np.random.default_rng(width + reach)
    a = rng.integers(-reach, reach + 1, (7, width)).astype(float)
    b = rng.integers(-reach, reach + 1, (9, width)).astype(float)
    a[0], b[0], b[1] = reach, reach, -reach  # the largest scores of either sign
    bound = width * reach * reach
    moduli = primes(bound)
    got = Residues(a, moduli).products(Residues(b, moduli), large=bound >= 1 << 46)
    assert [[int(x) for x in row] for row in got] == exact(a, b)


def test_primes_cover_the_bound():
    for bound in (1, 10**6, 10**12, 2**62):
        found = primes(bound)
        assert np.prod([int(p) for p in found], dtype=object) > 4 * bound and len(set(found)) == len(found)
        assert all(p < 1024 and all(p % d for d in range(2, p)) for p in found)
    with pytest.raises(ValueError):
        primes(10**1000)


def brute(rows, anchors, positives=5, negatives_=3, scale=256, low=50, high=95):
    valid = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v], y) for i, v, y in rows
             if i is not None and v is not None and y is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, va, ya in sorted({x[0]: x for x in valid if anchors(x[0])}.values()):
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, y) for i, v, y in valid if i != a)
        for p, i, _ in [x for x in scored if x[2] == ya][:positives]:
            fits = [x for x in scored if x[2] != ya and low * -p <= 100 * -x[0] <= high * -p][:negatives_]
            out += [(a, i, r + 1, x[1], -p, -x[0]) for r, x in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, is_anchor="vec_id % 5 = 0", **options):
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    return sorted(tuple(r) for r in negatives.mine(df, is_anchor, **options).collect())


def test_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist(), int(rng.integers(3))) for i in range(150)]
    want = brute(rows, lambda i: i % 5 == 0)
    assert len(want) > 100
    assert mined(spark, rows) == want
    assert mined(spark, rows, block=4) == want


def test_ties_copies_and_a_hot_group(spark):
    """A third of all rows are one vector, in two labels."""
    rows = [(i, [1.0, 0.5] if i % 3 == 0 else [float(i % 4), 0.25 * (i % 7)], i % 2) for i in range(120)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 5 == 0)
    assert mined(spark, rows, positives=2, negatives=5, low=10, high=100) == brute(
        rows, lambda i: i % 5 == 0, 2, 5, low=10, high=100
    )


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=3) * 1e5).tolist(), i % 2) for i in range(40)]
    assert mined(spark, rows, scale=4096) == brute(rows, lambda i: i % 5 == 0, scale=4096)


def test_rows_that_take_no_part(spark):
    odd = [(5, None, 1), (10, [1.0, None], 1), (15, [float("nan"), 1.0], 1), (20, [float("inf"), 1.0], 0),
           (25, [1.0, 1.0], None), (None, [1.0, 1.0], 0), (30, [], 0), (35, [0.0, 0.0], 1)]
    rows = [(i, [1.0 + i / 10, 1.0], i % 2) for i in range(1, 25) if i % 5] + odd + [(40, [2.0, 1.0], 0), (45, [2.0, 1.0], 1)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 5 == 0)
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0)]) == []
    assert mined(spark, [(5, [], 0), (6, [], 1)]) == []


def test_vectors_of_unequal_length_and_clashing_columns(spark):
    rows = [(i, [1.0 + i % 3, 2.0, 0.5][: 1 + i % 3], i % 2) for i in range(30)]
    padded = [(i, v + [0.0] * (3 - len(v)), y) for i, v, y in rows]
    want = brute(padded, lambda i: i % 5 == 0)
    assert mined(spark, rows) == want
    extra = "rank anchor_id positive_id positive_score negative_id score width reach row".split()
    df = spark.createDataFrame(rows, VECTORS).select("*", *(F.lit(7).alias(c) for c in extra))
    assert sorted(tuple(r) for r in negatives.mine(df, "vec_id % 5 = 0").collect()) == want


def test_repeated_ids(spark):
    rows = [(5, [1.0, 1.0], 0), (5, [1.0, 1.0], 0), (6, [0.9, 1.0], 0), (6, [0.9, 1.0], 0), (7, [0.7, 1.0], 1), (7, [0.7, 1.0], 1)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_the_query_agrees_with_sql(spark, medium_dir):
    name = "op13_hard_negatives"
    got = queries.queries()[name](spark, medium_dir)
    assert compare.difference(got, compare.connect(medium_dir), queries.oracle_sql()[name]) is None
