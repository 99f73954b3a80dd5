"""Exact top-k against DuckDB and against all products."""

import math
import random

import duckdb
import pytest

from revolva.llm import queries, topk

SCHEMA = "vec_id long, embedding array<double>, rank int, score string"


def brute(rows, k, scale=1024):
    rows = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in sorted(rows) if i % 3 == 0}.items():
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in topk.top_k(df, "vec_id % 3 = 0", **options).collect())


def test_table_matches_duckdb(spark, medium_dir):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{medium_dir}/embeddings.parquet')")
    want = connection.execute(queries.ORACLE["op4_exact_top_k"]).fetchall()
    got = queries.op4_exact_top_k(spark, medium_dir).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(want) == sorted(map(tuple, got)) and want


@pytest.mark.parametrize("slices, block", [(1, 4096), (2, 7), (3, 4096)])
def test_matches_all_products(spark, slices, block):
    random.seed(slices)
    rows = [(i, [random.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, [0.5] * 6) for i in range(40)]  # ties
    rows += [(300 + i, [-1.0] * 6) for i in range(5)]
    assert run(spark, rows, k=4, slices=slices, block=block) == brute(rows, 4)


def test_large_components_stay_exact(spark):
    rows = [(i, [1e5 * (i + 1) + 0.25 * i, 3e5 - i]) for i in range(9)]
    assert run(spark, rows, k=3) == brute(rows, 3)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    rows += [(4, [1.0]), (5, []), (7, [2.0, -3.0]), (7, [2.0, -3.0])]
    assert [r[2] for r in run(spark, rows, k=10)] == [4, 5, 7, 7]
    assert run(spark, [], k=10) == []
    assert run(spark, [(0, [1.0])], k=10) == []
