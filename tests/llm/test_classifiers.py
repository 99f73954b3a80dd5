"""Held-out accuracy of the classifiers, and their parts by hand."""

import numpy as np
import pyarrow as pa
import pytest
from helpers import clashing, documents, odd_rows
from pyspark.sql import functions as F

from revolva.llm import labelled, quality, queries, toxicity

LABELS = "doc_id long, quality int, toxic int, label int, score double"


@pytest.fixture(scope="module")
def labels(spark, medium_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{medium_dir}/labels.parquet").collect()}


def held_out(rows, labels, column):
    return [(r.score, r.predicted, labels[r.doc_id][column]) for r in rows if r.held_out and r.doc_id in labels]


def test_quality_of_held_out_documents(spark, medium_dir, labels):
    rows = queries.op3_quality_classifier(spark, medium_dir).collect()
    assert len(rows) == spark.read.parquet(f"{medium_dir}/documents.parquet").count()
    found = held_out(rows, labels, "quality")
    assert sum(p == y for _, p, y in found) >= 0.97 * len(found) > 50
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_toxicity_of_held_out_documents(spark, medium_dir, labels):
    rows = queries.op8_toxicity(spark, medium_dir).collect()
    assert len(rows) == spark.read.parquet(f"{medium_dir}/documents.parquet").count()
    found = held_out(rows, labels, "toxic")
    assert sum(p == y for _, p, y in found) >= 0.93 * len(found) > 50
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_votes_are_those_of_all_cosines():
    rng = np.random.default_rng(5)
    x = rng.random((200, quality.TERMS)).astype(np.float32)
    projection = quality.decompose(x, quality.DIMENSIONS)
    model = quality.Model(projection, np.zeros((0, quality.DIMENSIONS)), rng.integers(0, 2, 200).astype(float))
    model.vectors = model.latent(x)
    new = rng.random((9, quality.TERMS)).astype(np.float32)
    for got, line in zip(model.scores(new), new @ projection):
        cosines = sorted(((float(v @ line / np.linalg.norm(line)), y) for v, y in zip(model.vectors, model.labels)), reverse=True)
        votes = [(max(c, 0) ** quality.POWER, y) for c, y in cosines[: quality.NEIGHBOURS]]
        want = (sum(w * y for w, y in votes) + quality.DOUBT / 2) / (sum(w for w, _ in votes) + quality.DOUBT)
        assert abs(got - want) < 1e-4


def test_decomposition_keeps_the_leading_directions():
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(80, 5)) * [9, 7, 5, 3, 2]) @ rng.normal(size=(5, quality.TERMS))
    basis = quality.decompose(x.astype(np.float32), 5)
    assert np.allclose(x @ basis @ basis.T, x, atol=1e-2 * np.abs(x).max())


def test_features_by_hand():
    lexicon = toxicity.Lexicon(np.array([toxicity.word_hash("idiot"), toxicity.word_hash("scum")], np.uint64), np.array([3.0, 2.0]))
    texts = ["You IDIOT!", "i.d.i.o.t and a sc.um,", "1d10t here", None, "", "nothing else at all", "É You"]
    rows = [dict(zip(toxicity.FEATURES, r)) for r in toxicity.features(pa.array(texts), lexicon)]
    assert [r["strongest"] for r in rows] == [3, 3, 3, 0, 0, 0, 0]
    assert rows[1]["second"] == 2 and rows[0]["near_second_person"] == 0.5 and rows[2]["hidden_hits"] == 0.5
    assert rows[0]["capital_words"] == 0.5 and rows[0]["calls"] == 0.1 and rows[2]["obfuscated"] == 0.5
    assert all(v == 0 for v in rows[3].values()) and rows[3] == rows[4]
    assert toxicity.word_hash("ÉCOLE") == toxicity.word_hash("école")


def test_long_texts_and_batches_give_the_same_features():
    rng = np.random.default_rng(8)
    words = ["idiot", "you", "A", "bé", "x.y", "!!"]
    lexicon = toxicity.Lexicon(np.array([toxicity.word_hash("idiot")], np.uint64), np.array([1.5]))
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 5, 90_000, 3, 70_000, 2)]
    together = toxicity.features(pa.array(texts), lexicon)
    for i, t in enumerate(texts):
        assert np.allclose(together[i], toxicity.features(pa.array([t]), lexicon)[0])


def test_samples_are_bounded_and_settle_conflicts(spark):
    rows = [(i, i % 2, 0, 9, 0.5) for i in range(40)] + [(1, 0, 0, 9, 0.5), (None, 1, 1, 9, 0.5), (90, None, None, 9, 0.5), (91, 7, 7, 9, 0.5)]
    chosen = labelled.sample(spark.createDataFrame(rows, LABELS), "quality", F.lit(True), 5).collect()
    assert sorted(r.label for r in chosen) == [0] * 5 + [1] * 5
    every = {r.doc_id: r.label for r in labelled.sample(spark.createDataFrame(rows, LABELS), "quality", F.lit(True), 99).collect()}
    assert every[1] == 0 and every[3] == 1 and not {None, 90, 91} & every.keys()


def test_odd_rows_and_no_labels(spark):
    df = clashing(documents(spark, odd_rows()))
    none = spark.createDataFrame([], LABELS)
    some = spark.createDataFrame([(4, 1, 1, 0, 0.0), (5, 0, 0, 0, 0.0), (6, None, None, None, None)], LABELS)
    for labels in (none, some):
        model = quality.train(df, labels, F.lit(True))
        assert quality.scored(df, model).count() == df.count()
        assert {r.score for r in quality.scored(df, model).collect() if r.doc_id in (1, 2)} == {0.5}
        assert quality.stage(df, model).columns == df.columns
        trees = toxicity.train(df, labels, F.lit(True))
        assert toxicity.scored(df, trees).count() == df.count()
        assert toxicity.scored(df.where("false"), trees).count() == 0


def test_samples_hold_one_row_of_an_id(spark):
    rows = [(1, "b"), (1, "a"), (1, None), (2, None), (3, "c")] + [(4, f"text {i}") for i in range(500)]
    chosen = spark.createDataFrame([(1, 0), (2, 1), (4, 1)], "doc_id long, label int")
    got = sorted(map(tuple, labelled.texts(documents(spark, rows), chosen).collect()))
    assert got == [(1, 0, "a"), (2, 1, None), (4, 1, "text 0")]
