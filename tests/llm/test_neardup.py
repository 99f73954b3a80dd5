"""Near-duplicates against all pairs."""

import random

import numpy as np
from helpers import clashing, documents, linked, odd_rows

from revolva.llm import neardup, queries
from revolva.llm.components import components


def test_table_matches_all_pairs(spark, small_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    component, sizes = linked(texts, 4)
    got = queries.op7_minhash_near_dedup(spark, small_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {
        i: (sizes[i], c, i == c) for i, c in component.items()
    }
    assert len(got) == len(texts) > len(set(component.values()))


def test_chains_and_border_cases_match_all_pairs(spark):
    random.seed(8)
    texts, word = {}, lambda: "w%05d" % random.randrange(99_999)
    for chain in range(12):  # each is near the one before only
        words = [word() for _ in range(random.choice((5, 30, 60, 200)))]
        for step in range(8):
            texts[100 * chain + step] = " ".join(words)
            for _ in range(max(1, len(words) // 40)):
                words[random.randrange(len(words))] = word()
    common = [word() for _ in range(40)]
    for i in range(40):  # share half
        texts[5000 + i] = " ".join(common + [word() for _ in range(40)])
    component, sizes = linked(texts, 5)
    got = neardup.near_duplicates(documents(spark, list(texts.items()))).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (sizes[i], c) for i, c in component.items()}


def test_odd_rows(spark):
    df = clashing(documents(spark, odd_rows()))
    got = sorted(map(tuple, neardup.near_duplicates(df).collect()), key=str)
    assert len(got) == len(odd_rows())
    assert (1, 0, 1, True) in got and (2, 0, 2, True) in got and (3, 0, 3, True) in got
    assert got.count((5, 2, 5, True)) == 2 and (None, 2, None, True) in got and (6, 1, 6, True) in got
    assert neardup.near_duplicates(documents(spark, [])).count() == 0


def test_stage_keeps_columns_and_one_of_each_group(spark):
    text = " ".join(map(str, range(60)))
    df = documents(spark, [(3, text), (1, text + " x"), (2, "other text of its own kind"), (None, text)])
    kept = neardup.stage(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, None]


def test_stage_decides_by_row(spark, small_dir):
    import corpus_pipeline

    one, two, three, four = (" ".join(f"{k}w{i}" for i in range(60)) for k in "abcd")
    rows = [(1, one), (2, one), (2, two), (3, three), (3, three), (3, three + " x"), (None, one), (None, four), (None, four), (None, None), (4, "")]
    df = clashing(documents(spark, rows))
    kept = corpus_pipeline.drop_near_copies(spark, df.repartition(5), small_dir)
    assert kept.columns == df.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    got = [(i, three if t == three + " x" else t) for i, t in got]  # either row of id 3 may stay
    assert sorted(got, key=str) == sorted([(1, one), (2, two), (3, three), (None, four), (None, None), (4, "")], key=str)
    alone = sorted(((r.doc_id, r.text) for r in neardup.stage(df).collect()), key=str)
    assert len(alone) == 8 and alone.count((None, four)) == 2 and (None, one) in alone


def test_signatures_within_the_distance_share_a_key():
    rng = np.random.default_rng(2)
    import pyarrow as pa

    for errors in range(neardup.DISTANCE + 1):
        a = rng.integers(0, 1 << 16, neardup.POSITIONS).astype("<u2")
        b = a.copy()
        b[rng.choice(neardup.POSITIONS, errors, replace=False)] += 1
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([9, 9]), pa.array([a.tobytes(), b.tobytes()])], ["id", "n", "signature"])
        keys = next(iter(neardup._keys([batch]))).column(0).to_numpy().reshape(2, -1)
        assert set(keys[0]) & set(keys[1])


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, x) for x in range(1001, 1050)] + [(7, 7), (2000, 1999), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(1000, 1050)} == {1000} and got[2000] == 1999
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
