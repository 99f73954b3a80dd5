"""Collision counting: windows and counts against all projections, recall against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from revolva.llm import collisions, queries

VECTORS = "vec_id long, embedding array<float>"


def cosines(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    return float((a * b).sum() / np.sqrt((a * a).sum()) / np.sqrt((b * b).sum()))


def brute(rows, asked, k=5):
    valid = [(i, [float(np.float32(x)) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in valid), default=0)
    valid = [(i, v + [0.0] * (width - len(v))) for i, v in valid]
    out = {}
    for q, vq in {i: v for i, v in valid if asked(i)}.items():
        near = sorted((-cosines(vq, v), i) for i, v in valid if i != q)
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


def found(df, is_query="vec_id % 5 = 0", **options):
    out = {}
    for r in sorted(collisions.nearest(df, is_query, **options).collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def same(got, want):
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    for q, near in want.items():
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in near], abs=1e-12)


def test_windows_hold_what_is_within_reach():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(500, 8))
    lines = rng.normal(size=(12, 8))
    segment = collisions.Segment(np.arange(500), rows, lines)
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    projected = unit @ lines.T
    for half in (0.0, 0.1, 0.7, 100.0, np.inf):
        low, high = segment.window(projected[3], half)
        counts = segment.collided([segment.order[a:b] for a, b in zip(low, high)])
        assert np.abs(counts - (np.abs(projected - projected[3]) <= half + 1e-9).sum(axis=1)).max() <= (1 if half == 0 else 0)


def test_the_chance_of_a_collision():
    draws = np.random.default_rng(3).standard_normal(400_000)
    assert (np.abs(draws) <= collisions.HALF_WIDTH).mean() == pytest.approx(collisions.COLLISION, abs=3e-3)
    n, l = collisions.PROJECTIONS, collisions.threshold(collisions.PROJECTIONS)
    counts = np.random.default_rng(4).binomial(n, collisions.COLLISION, 200_000)
    assert (counts < l).mean() < 0.03


def test_recall_and_scores_on_the_table(spark, medium_dir):
    df = spark.read.parquet(f"{medium_dir}/embeddings.parquet")
    want = brute([(r.vec_id, list(r.embedding)) for r in df.collect()], lambda i: i % 50 == 0)
    got: dict = {}
    for r in queries.queries()["op11_nearest_neighbours"](spark, medium_dir).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in near}) for q, near in want.items())
    assert hits >= 0.97 * 5 * len(want)
    exact = {r.vec_id: list(r.embedding) for r in df.collect()}
    for q, near in got.items():
        assert [s for _, s in near] == pytest.approx([cosines(exact[q], exact[i]) for i, _ in near], abs=1e-14)


def test_recall_on_clusters_in_small_segments(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 24))
    rows = [(i, (centres[i % 20] + 0.2 * rng.normal(size=24)).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    want, got = brute(rows, lambda i: i % 5 == 0), found(df, block=64)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in near}) for q, near in want.items())
    assert hits >= 0.95 * 5 * len(want)


def test_copies_and_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else [float(i % 5) - 2, 1.0, 0.5]) for i in range(150)]
    same(found(spark.createDataFrame(rows, VECTORS).repartition(3)), brute(rows, lambda i: i % 5 == 0))


def test_few_candidates(spark):
    for n in (1, 2, 4, 6):
        rows = [(5 * i, [1.0, float(i)]) for i in range(n)]
        want = {q: x for q, x in brute(rows, lambda i: i % 5 == 0).items() if x}
        same(found(spark.createDataFrame(rows, VECTORS)), want)


def test_rows_that_take_no_part(spark):
    rows = [(5, None), (10, [1.0, None]), (15, [float("nan"), 1.0]), (20, [float("-inf"), 1.0]), (25, [0.0, 0.0]), (30, []),
            (None, [1.0, 1.0]), (35, [1.0]), (40, [1.0, 2.0]), (41, [-1.0, -2.0]), (42, [1e30, 2e30]), (43, [1e-30, -1e-30])]
    extra = "rank score query_id embedding_norm width segment".split()
    df = spark.createDataFrame(rows, VECTORS).select("*", *(F.lit(7).alias(c) for c in extra))
    same(found(df), brute(rows, lambda i: i % 5 == 0))
    assert found(spark.createDataFrame([], VECTORS)) == {}
    assert found(spark.createDataFrame([(5, [0.0])], VECTORS)) == {}


def test_components_whose_squares_leave_the_range(spark):
    rows = [(i, [1e200 * (i + 1), 1e200 * (i % 7), -1e200]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    small = [(i, [x / 1e200 for x in v]) for i, v in rows]
    want = brute(small, lambda i: i % 5 == 0)
    assert {q: [i for i, _ in x] for q, x in found(df).items()} == {q: [i for i, _ in x] for q, x in want.items()}
