"""Token counts, records and packing against the tokenizers library on whole texts."""

import random
import zlib

import numpy as np
import pytest
from helpers import clashing, documents, odd_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from revolva.llm import packing, queries, records, token_counts, tokens
from revolva.llm.session import scratch

PATH = tokens.vocabulary()


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def truth(spark, small_dir, library):
    rows = spark.read.parquet(f"{small_dir}/documents.parquet").orderBy("doc_id").collect()
    return [(r, library(r.text)) for r in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_are_encoded_as_the_whole_text(library):
    random.seed(3)
    signs = ["a", "B", "é", "9", "'s", "'", ".", "!?", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", " ", "\x1c", "\x0b", "漢", "😀", "<|endoftext|>"]
    encode = tokens.Encoder(PATH)
    texts = ["".join(random.choices(signs, k=random.randint(0, 40))) for _ in range(3000)] + [None]
    for text, got in zip(texts, encode.batch(texts)):
        assert np.frombuffer(got, encode.dtype).tolist() == library(text), repr(text)


def test_counts_match_the_library(spark, small_dir, truth):
    want = {}
    for r, ids in truth:
        n, t = want.get((r.source, r.lang), (0, 0))
        want[r.source, r.lang] = n + 1, t + len(ids)
    got = {(r.source, r.lang): (r.documents, r.tokens) for r in queries.op2_token_counts(spark, small_dir).collect()}
    assert got == want


def test_ledger_adds_signed_changes_once(spark):
    ledger = token_counts.Ledger(spark, scratch(spark, "ledger"))
    assert ledger.totals().count() == 0
    first = documents(spark, [(1, "one two"), (2, "three"), (3, None)])
    assert ledger.commit("a", token_counts.counted(first, PATH, "v1"))
    assert not ledger.commit("a", token_counts.counted(first, PATH, "v1"))
    gone = documents(spark, [(2, "three")])
    assert ledger.commit("b", token_counts.counted(gone, PATH, "v1", -1))
    revised = token_counts.counted(documents(spark, [(1, "one two")]), PATH, "v1", -1)
    revised = revised.unionByName(token_counts.counted(documents(spark, [(1, "one two three four")]), PATH, "v2"))
    ledger.commit("c", revised)
    assert {(r.tokenizer, r.documents, r.tokens) for r in ledger.totals().collect()} == {("v1", 1, 0), ("v2", 1, 4)}
    with pytest.raises(ValueError):
        ledger.commit("../x", first)


def changes(spark, *rows):
    return spark.createDataFrame(rows, "source string, lang string, tokenizer string, documents long, tokens long")


def sums(ledger):
    return {(r.source, r.documents, r.tokens) for r in ledger.totals().collect()}


def test_totals_are_a_snapshot_and_later_batches(spark, tmp_path):
    ledger = token_counts.Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.compact() and ledger.totals().count() == 0
    ledger.commit("a", changes(spark, ("x", "en", "v", 2, 20), ("y", "en", "v", 1, 5)))
    ledger.commit("b", changes(spark, ("x", "en", "v", -1, -7)))
    before = sums(ledger)
    assert ledger.compact() and sums(ledger) == before == {("x", 1, 13), ("y", 1, 5)}
    parts = lambda: [str(p.relative_to(tmp_path / "ledger")).split("/")[0] for p in tmp_path.rglob("part-*.parquet")]
    assert set(parts()) == {"snapshot"}
    assert not ledger.commit("a", changes(spark, ("x", "en", "v", 9, 9)))  # still known
    ledger.commit("c", changes(spark, ("y", "en", "v", -1, -5), ("z", "en", "v", 1, 1)))
    assert sums(ledger) == {("x", 1, 13), ("z", 1, 1)}
    assert ledger.compact() and ledger.compact() and sums(ledger) == {("x", 1, 13), ("z", 1, 1)}
    assert ledger.batches() == ["a", "b", "c"] and set(parts()) == {"snapshot"}


def test_commits_do_not_rest_on_success_markers(spark, tmp_path):
    ledger = token_counts.Ledger(spark, f"file://{tmp_path}/ledger")
    conf = spark._jsc.hadoopConfiguration()
    conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        assert ledger.commit("a", changes(spark, ("x", "en", "v", 1, 3)))
    finally:
        conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")
    assert sums(ledger) == {("x", 1, 3)} and not ledger.commit("a", changes(spark, ("x", "en", "v", 1, 3)))


def test_writers_of_one_batch_and_of_one_snapshot(spark, tmp_path, monkeypatch):
    """Two writers that both saw nothing: the first counts, the other leaves no trace."""
    ledger, other = (token_counts.Ledger(spark, f"file://{tmp_path}/ledger") for _ in range(2))
    first = ledger._write
    def race(sums, name):
        data = first(sums, name)
        monkeypatch.setattr(ledger, "_write", first)
        assert other.commit("a", changes(spark, ("x", "en", "v", 1, 3)))
        return data
    monkeypatch.setattr(ledger, "_write", race)
    assert not ledger.commit("a", changes(spark, ("x", "en", "v", 5, 50)))
    assert sums(ledger) == {("x", 1, 3)}
    def late(sums, name):
        data = first(sums, name)
        monkeypatch.setattr(ledger, "_write", first)
        other.commit("b", changes(spark, ("y", "en", "v", 1, 1)))
        assert other.compact()
        return data
    monkeypatch.setattr(ledger, "_write", late)
    assert not ledger.compact()
    assert sums(ledger) == {("x", 1, 3), ("y", 1, 1)}
    assert len({p.parent for p in tmp_path.rglob("part-*.parquet")}) == 1


def test_counts_of_odd_rows(spark):
    ledger = token_counts.Ledger(spark, scratch(spark, "ledger"))
    df = clashing(documents(spark, odd_rows()))
    ledger.commit("a", token_counts.counted(df, PATH, "v"))
    ledger.commit("b", token_counts.counted(df.where("false"), PATH, "v"))
    got = {(r.source, r.lang): r.documents for r in ledger.totals().collect()}
    assert got == {(None, None): 2, ("s", "en"): 4, (None, "en"): 1, ("s", None): 1, ("s", "fr"): 1}


def test_records_match_the_library(spark, small_dir, truth):
    start, want = 0, []
    for r, ids in truth:
        ids = ids + [0]
        want.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    got = queries.op5_token_records(spark, small_dir).collect()
    assert sorted(tuple(r) for r in got) == want


def test_records_are_read_in_any_order_and_verified(spark, library, tmp_path):
    folder = f"file://{tmp_path}/r"
    df = clashing(documents(spark, odd_rows() + [(9, "abc " * i) for i in range(30)]))
    records.write_records(df, folder, PATH, shards=3)
    index = records.read_index(spark, folder).cache()
    assert index.count() == df.count()
    got = records.read_records(index.orderBy(F.rand(4)), folder, PATH).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in df.collect()), key=lambda x: (x is not None, x))
    assert sorted(tuple(r.ids) for r in got) == sorted(tuple(library(r.text) + [0]) for r in df.collect())
    ends = [0] + list(np.cumsum([len(r.ids) for r in got]))
    assert [r.start for r in got] == ends[:-1]
    file = next(p for p in sorted((tmp_path / "r" / "shards").iterdir()) if p.stat().st_size > 40 and p.suffix == ".rec")
    data = bytearray(file.read_bytes())
    data[13] ^= 1
    file.write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        records.read_records(index, folder, PATH).collect()


def test_frame_round_trip_and_damage():
    for payload in (b"", b"x", bytes(range(256)) * 9):
        record = records.frame(payload)
        assert records.unframe(record) == payload
        for at in range(0, len(record), 7):
            bad = bytearray(record)
            bad[at] ^= 4
            with pytest.raises(ValueError):
                records.unframe(bytes(bad))
    with pytest.raises(ValueError):
        records.unframe(b"short")


def test_no_records_of_an_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    records.write_records(documents(spark, []), folder, PATH)
    assert records.read_records(records.read_index(spark, folder), folder, PATH).count() == 0


def check_packing(rows, texts, capacity):
    """Every id is in one piece and one place; sequences have no gaps."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        ids, at = texts[doc], 0
        for k, r in enumerate(pieces):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == crc(ids[at : at + r.length])
            assert r.length <= capacity and (k == 0 or r.length == capacity)
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_packing_of_the_table(spark, small_dir, truth):
    rows = queries.op6_best_fit_packing(spark, small_dir).collect()
    texts = {r.doc_id: ids + [0] for r, ids in truth}
    bins = check_packing(rows, texts, 2048)
    assert bins <= 1.01 * sum(map(len, texts.values())) / 2048 + 1


def test_packing_of_odd_rows_in_small_groups(spark, library):
    unique = [(i, r[1]) for i, r in enumerate(odd_rows())] + [(100 + i, "word " * (i % 50)) for i in range(300)]
    df = clashing(documents(spark, unique))
    rows = packing.packed(df, PATH, capacity=64, group=100).collect()
    check_packing(rows, {i: library(t) + [0] for i, t in unique}, 64)
    repeated = packing.packed(documents(spark, odd_rows()), PATH).collect()
    assert sum(r.piece == 0 for r in repeated) == len(odd_rows())
    assert packing.packed(documents(spark, []), PATH).count() == 0


def test_local_search_empties_bins():
    fixed = np.array([6, 6, 4, 3, 3, 2])  # two bins of 12 hold all
    start = np.array([0, 1, 0, 1, 2, 2])
    assert len(set(packing.improve(fixed, start, 12).tolist())) == 2
    random.seed(5)
    for _ in range(30):
        lengths = np.array([random.randint(20, 90) for _ in range(120)])
        before = packing.best_fit(lengths, 100)
        after = packing.improve(lengths, before, 100)
        fills = np.bincount(after, weights=lengths)
        assert fills.max() <= 100
        assert (fills**2).sum() >= (np.bincount(before, weights=lengths) ** 2).sum()
        assert len(set(after.tolist())) <= len(set(before.tolist()))


def test_strings_of_special_tokens_are_as_in_the_library(spark, tmp_path):
    contract = lambda text: Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids
    encode, random_ = tokens.encoder(PATH), random.Random(7)
    assert np.frombuffer(encode.batch(["a <|endoftext|> b"])[0], encode.dtype).tolist() == [64, 220, 50256, 275]
    signs = ["a", "é", "'s", ".", " ", "  ", "\n", "\t", "\xa0", "<|endoftext|>", "<|endof", "text|>", "<|end oftext|>"]
    texts = ["".join(random_.choices(signs, k=random_.randint(0, 20))) for _ in range(300)]
    library = Tokenizer.from_file(PATH)
    for text, got in zip(texts, encode.batch(texts)):
        assert np.frombuffer(got, encode.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    rows = [(1, "a <|endoftext|> b"), (2, "c<|endoftext|>")]
    df, wanted = documents(spark, rows), {i: contract(t) for i, t in rows}
    assert token_counts.counted(df, PATH, "v").agg(F.sum("tokens")).first()[0] == sum(map(len, wanted.values()))
    records.write_records(df, folder := f"file://{tmp_path}/special", PATH)
    got = records.read_records(records.read_index(spark, folder), folder, PATH).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {i: ids + [tokens.END_ID] for i, ids in wanted.items()}
    pieces = packing.packed(df, PATH).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in pieces} == {i: (len(ids) + 1, crc(ids + [tokens.END_ID])) for i, ids in wanted.items()}


def test_sums_of_a_batch_are_written_by_many_tasks(spark, tmp_path):
    changes = spark.range(4000).selectExpr("cast(id as string) source", "'en' lang", "'v' tokenizer", "1L documents", "id tokens")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "6")
        ledger = token_counts.Ledger(spark, f"file://{tmp_path}/ledger")
        ledger.commit("a", changes)
        assert len(list((tmp_path / "ledger" / "batch=a").rglob("part-*.parquet"))) > 1
        assert ledger.totals().count() == 4000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_the_search_ends_when_no_bin_can_be_emptied():
    """Lengths that best fit packs badly: the search comes closer to the bound, however many bins resist."""
    lengths = np.random.default_rng(0).integers(600, 1100, 1500)
    before = packing.best_fit(lengths, 2048)
    after = packing.improve(lengths, before, 2048)
    assert np.bincount(after, weights=lengths).max() <= 2048
    least, used = -(-int(lengths.sum()) // 2048), len(np.unique(after))
    assert least <= used < len(np.unique(before))
    assert len(np.unique(packing.improve(lengths, np.unique(after, return_inverse=True)[1], 2048))) <= used
