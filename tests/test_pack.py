"""The reports of one pack equal those of the single operators."""

import re

import pytest
from panels import statement

from revolva.operators import charts, delinquency, kpis, pack
from revolva.sources import store

PAIRS = [
    (pack.monthly_trend, kpis.monthly_trend),
    (pack.month_on_month, delinquency.month_on_month),
    (pack.payment_types, kpis.by_payment_type),
    (pack.bucket_distribution, charts.bucket_distribution),
    (pack.monthly_rates, charts.monthly_trend),
]


@pytest.fixture(scope="module")
def p(spark, small_dir):
    return store.load(spark, small_dir)


@pytest.fixture(scope="module")
def packed(p):
    return store.kept(pack.pack(p), "pack")


@pytest.mark.parametrize(("derived", "single"), PAIRS)
def test_same_report(p, packed, derived, single):
    got, want = derived(packed), single(p)
    assert got.columns == want.columns and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert got.collect() == want.collect()


def test_missing_values_and_empty_panels(make):
    odd = make([statement(1, 0, dpd=None, label=None), statement(2, 0, paid=None), statement(3, 1, balance=None, dpd=95)])
    for source in (odd, make([])):
        rows = pack.pack(source)
        for derived, single in PAIRS:
            assert derived(rows).collect() == single(source).collect(), single.__name__


def test_one_scan_and_cells_are_expanded_not_statements(p):
    text = pack.pack(p)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation ") == 1 and text.count("Expand") == 1
    below = text[text.index("Expand") :]
    assert re.search(r"Expand.*?Aggregate.*?Relation", below, re.S)
