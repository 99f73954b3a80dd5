"""Each stage on its own input, against brute force."""

import __spark_entry__
import corpus_pipeline
import pytest
from helpers import clashing, documents, linked, odd_rows
from test_decontamination import brute
from test_secrets import plain


@pytest.fixture(scope="module")
def steps(spark, small_dir, tmp_path_factory):
    """What goes into and comes out of each stage."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{small_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small_dir).write.parquet(path := f"{folder}/{k}")
        after = spark.read.parquet(path)
        out.append((docs.collect(), after.collect(), after.columns))
        docs = after
    return out


def test_columns_stay_until_the_last_stage(steps):
    assert len(steps) == 5
    for before, _, columns in steps[:-1]:
        assert columns == ["doc_id", "text", "lang", "source", "n_chars"] and before


def test_bad_documents_go_and_good_ones_stay(spark, small_dir, steps):
    before, after, _ = steps[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    judged = [r.doc_id in kept for r in before if labels.get(r.doc_id) == 1]
    assert sum(judged) >= 0.97 * len(judged)
    bad = [r.doc_id in kept for r in before if labels.get(r.doc_id) == 0]
    assert sum(bad) <= 0.3 * len(bad)


def test_one_of_each_group_of_near_copies_stays(steps):
    before, after, _ = steps[1]
    component, _ = linked({r.doc_id: r.text for r in before}, 5)
    assert sorted(r.doc_id for r in after) == sorted({c for c in component.values()})


def test_documents_with_benchmark_passages_go(spark, small_dir, steps):
    before, after, _ = steps[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    bad = {i for i, _ in brute([(r.doc_id, r.text) for r in before], items)}
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if r.doc_id not in bad)


def test_secrets_are_masked_and_the_rest_stays(steps):
    before, after = ({r.doc_id: r for r in rows} for rows in steps[3][:2])
    assert before.keys() == after.keys()
    for i, r in before.items():
        if plain(r.text):
            assert "[SECRET]" in after[i].text and not plain(after[i].text) and after[i].n_chars == len(after[i].text)
        else:
            assert after[i] == r


def test_every_kept_document_is_packed(spark, small_dir, steps):
    before, after, _ = steps[4]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    whole = __spark_entry__.queries()["pipeline"](spark, small_dir).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in after)


def test_odd_rows_pass_all_stages(spark, small_dir):
    for rows in (odd_rows(), []):
        df = clashing(documents(spark, rows))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, df, small_dir)
            assert after.columns == df.columns
            df = after
        assert corpus_pipeline.STAGES[-1][1](spark, df, small_dir).count() >= len(rows) // 2
