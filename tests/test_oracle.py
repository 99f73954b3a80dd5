"""Every query with an SQL equivalent agrees with it exactly: names, types, rows."""

import compare
import pytest

import oracle
from revolva import registry

SQL = oracle.build()


@pytest.fixture(scope="module")
def duck(small_dir):
    return compare.connect(small_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_result(spark, duck, small_dir, name):
    df = registry.build()[name](spark, small_dir)
    assert compare.difference(df, duck, SQL[name]) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(registry.build())


def test_only_the_fitted_model_lacks_sql():
    missing = set(registry.build()) - set(SQL)
    assert all(n.startswith("default_model_") or n == "final_summary" for n in missing)
