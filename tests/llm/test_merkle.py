"""Merkle manifests against trees that are built one node after the other."""

import hashlib
import zlib

import compare
import pytest
from helpers import LONG, clashing, documents, odd_rows
from pyspark.sql import functions as F

from revolva.llm import merkle, queries

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    values = (doc_id, source, lang, n_chars, text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """(root, siblings of each node as (left, right) level by level)."""
    paths, at, of = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(at) > 1:
        for i, place in enumerate(of):
            first = place // 16 * 16
            run = at[first : first + 16]
            paths[i].append(("".join(run[: place - first]), "".join(run[place - first + 1 :])))
        of = [p // 16 for p in of]
        at = [h(*at[i : i + 16]) for i in range(0, len(at), 16)]
    return at[0], paths


def expected(rows, tampered):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups, subroots = [], []
    for source in sources:
        mine = sorted(((r[0] is not None, r[0] or 0, leaf(*r), r) for r in rows if r[3] == source), key=lambda x: x[:3])
        subroot, paths = climb([x[2] for x in mine])
        groups.append((mine, paths))
        subroots.append(subroot)
    root, upper = climb(subroots)
    out = []
    for (mine, paths), subroot, above in zip(groups, subroots, upper):
        for (_, _, own, row), path in zip(mine, paths):
            state = own
            if tampered(row) and row[1] is not None:
                low = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1])
                state = leaf(row[0], low, *row[2:])
            for left, right in path + above:
                state = h(left, state, right)
            proof = h(*(left + right for left, right in path + above))
            out.append((row[0], own, subroot, root, proof, state, state == root))
    return sorted(out, key=str)


def every_fifth(row):
    return row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0


def manifest(df):
    got = merkle.manifest(df, F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


def check(spark, rows):
    assert manifest(documents(spark, rows)) == expected(rows, every_fifth)


def test_trees_of_every_shape_and_a_hot_source(spark):
    """Sources of 1 to 273 rows, one of 4,400 in three rounds, and more sources than a run holds."""
    sizes = [1, 2, 15, 16, 17, 33, 256, 257, 273, 4400, *[1] * 20]
    names = [f"{'Zé'[i % 2]}{i}" for i in range(len(sizes))]
    rows = [(1000 * j + 7 * i, f"Text {i}", "en", names[j], i) for j, n in enumerate(sizes) for i in range(n)]
    check(spark, rows)


@pytest.mark.parametrize("count", [1, 17])
def test_a_single_source(spark, count):
    check(spark, [(i, f"Text {i}", "en", "s", i) for i in range(count)])


def test_odd_rows(spark):
    rows = odd_rows() + [(7, "A:B-", "", "", None), (8, "ÀÉ ABC", "en", None, 3), (9, LONG.upper(), "en", "s", 1)]
    assert manifest(clashing(documents(spark, rows))) == expected(rows, every_fifth)


def test_equal_rows_hold_places_of_their_own(spark):
    rows = [(1, "Same", "en", "s", 4)] * 600 + [(2, "Other", "en", "s", 5)]
    check(spark, rows)


def test_an_empty_table(spark):
    assert manifest(documents(spark, [])) == []


def test_tampering_is_found_only_where_a_leaf_changes(spark):
    rows = [(i, "UPPER" if i % 2 else "lower", "en", "s", 5) for i in range(60)]
    got = merkle.manifest(documents(spark, rows), F.lit(True)).collect()
    assert {(r.doc_id % 2 == 1, r.verified) for r in got} == {(True, False), (False, True)}
    before = merkle.manifest(documents(spark, rows[::-1])).collect()
    assert all(r.verified for r in before) and {r.root for r in before} == {r.root for r in got}


def test_the_query_agrees_with_sql(spark, small_dir):
    name = "op12_merkle_manifest"
    got = queries.queries()[name](spark, small_dir)
    assert compare.difference(got, compare.connect(small_dir), queries.oracle_sql()[name]) is None


def test_windows_hold_one_block(spark, medium_dir):
    """Every window of the plan is dealt by block, never by source alone."""
    df = spark.read.parquet(f"{medium_dir}/documents.parquet")
    nodes = df.select(F.col("source").alias("grp"), F.col("doc_id").alias("pos"), F.lit(1000).alias("n"), merkle.leaf().alias("node"))
    plan = merkle.climbed(nodes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(grp" in plan and "block" in plan
