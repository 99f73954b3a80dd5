"""Decontamination against all windows of all documents."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import clashing, documents, odd_rows

from revolva.llm import decontamination as d
from revolva.llm import queries

RUN = re.compile(r"(?:[a-z0-9]|[^\x00-\x7f])+")


def bag(words, k=5):
    k = min(k, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def alike(a, b):
    shared = (a & b).total()
    return shared / (a.total() + b.total() - shared)


def brute(docs, items, k=5):
    found = {}
    for i, t in docs:
        words = RUN.findall((t or "").lower())
        for j, u in items:
            item = RUN.findall((u or "").lower())
            if not item or not words or not set(bag(words, min(k, len(item)))) & set(bag(item, k)):
                continue
            n = min(len(item), len(words))
            best = max(alike(bag(words[s : s + n], min(k, len(item))), bag(item, k)) for s in range(len(words) - n + 1))
            if best >= 0.8 - 1e-12:
                found[i, j] = max(best, found.get((i, j), 0))
    return found


def frame(spark, items):
    return spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")


def got(df):
    out = {}
    for r in df.collect():
        out[r.doc_id, r.item_id] = max(r.similarity, out.get((r.doc_id, r.item_id), 0))
    return out


def near(a, b):
    return a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_table_matches_all_windows(spark, small_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    want = brute(docs, items)
    assert want and near(got(queries.op1_decontamination(spark, small_dir)), want)


def test_changed_and_cut_passages_match_all_windows(spark):
    random.seed(4)
    word = lambda: "w%04d" % random.randrange(9999)
    items = [(i, " ".join(word() for _ in range(random.choice((3, 7, 20, 45, 60))))) for i in range(30)]
    docs = []
    for i in range(200):
        words = items[i % 30][1].split()
        for _ in range(random.randrange(2)):
            words[random.randrange(len(words))] = word()
        words = words[random.randrange(3) : len(words) - random.randrange(3)]
        docs.append((i, ", ".join([word() for _ in range(random.randrange(30))] + words + [word() for _ in range(5)]).upper()))
    want = brute(docs, items)
    result = d.contaminated(documents(spark, docs), frame(spark, items), items=7)
    assert len(want) > 30 and near(got(result), want)


def test_odd_rows(spark):
    items = [(1, None), (2, ""), (3, "!!"), (4, "one two, three four FIVE six"), (None, "one two three four five six"), (5, "one")]
    df = clashing(documents(spark, odd_rows()))
    result = sorted(((r.doc_id, r.item_id, r.similarity) for r in d.contaminated(df, frame(spark, items)).collect()), key=str)
    assert result == sorted([(i, j, 1.0) for i in (5, 5, None) for j in (4, 5, None)], key=str)
    kept = d.stage(df, frame(spark, items))
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6]
    assert d.contaminated(documents(spark, []), frame(spark, items)).count() == 0
    assert d.contaminated(df, frame(spark, [])).count() == 0


def test_index_finds_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(1)
    held = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    for far in range(d.RADIUS + 1):
        flips = sum(1 << int(b) for b in rng.choice(64, far, replace=False))
        prints = held ^ np.uint64(flips)
        met, distance = d.compared(prints[:, None], held[None, :])
        assert met.diagonal().all() and (distance.diagonal() == far).all()
        assert int(met.sum()) == int((np.bitwise_count(prints[:, None] ^ held[None, :]) <= d.RADIUS).sum())



def _crowded(items, words=30, seed=5):
    rng = random.Random(seed)
    lexicon = [f"w{i}" for i in range(4000)]
    return [(i, " ".join(rng.choices(lexicon, k=words))) for i in range(items)]


def test_a_document_that_holds_much_of_the_benchmark():
    """2,000 of 4,000 items in one text: all are found, in seconds and without much memory."""
    import time
    import tracemalloc

    items = _crowded(4000)
    index = d.Index(items, d.SHINGLE, d.PERCENT)
    hashes, _ = d.text_words(pa.array([" and so on ".join(t for _, t in items[:2000])]))
    tracemalloc.start()
    start = time.process_time()
    found = index.matches(hashes)
    spent, (_, peak) = time.process_time() - start, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert sorted(m[0] for m in found) == list(range(2000))
    assert all(m[-1] == 1.0 and m[3] == 0 for m in found)
    assert spent < 10 and peak < 300e6  # tracing alone doubles the time


def test_equal_to_all_windows_on_crowded_texts():
    """Items that share most shingles, copies among them, and texts that hold them changed or cut."""
    rng = random.Random(6)
    base = _crowded(6, words=24)
    items = [(10 * i + k, " ".join(w if rng.random() > k / 30 else "x" for w in t.split())) for i, t in base for k in range(5)]
    items += [(90, items[0][1]), (91, "one two three"), (92, "one"), (93, base[0][1] + " " + base[1][1])]
    texts = [" ".join(rng.sample([t for _, t in items], 9)) for _ in range(4)]
    texts += [" ".join(w for w in base[2][1].split() if rng.random() > 0.06), base[3][1][:80], "one two three one"]
    docs = list(enumerate(texts))
    index = d.Index(items, d.SHINGLE, d.PERCENT)
    got = {}
    for i, t in docs:
        hashes, _ = d.text_words(pa.array([t]))
        got |= {(i, m[0]): m[-1] for m in index.matches(hashes)}
    assert near(got, brute(docs, items))


def test_small_slices_and_regions_change_nothing(monkeypatch):
    items = _crowded(60, words=20)
    text = " ".join(t for _, t in items)
    index = d.Index(items, d.SHINGLE, d.PERCENT)
    hashes, _ = d.text_words(pa.array([text]))
    want = sorted(index.matches(hashes))
    monkeypatch.setattr(d, "PAIRS", 7)
    monkeypatch.setattr(d, "REGION", 5)
    assert sorted(index.matches(hashes)) == want and len(want) == 60


def test_ties_go_to_the_first_window():
    item = "a b c d e f g h i j"
    index = d.Index([(1, item)], d.SHINGLE, d.PERCENT)
    hashes, _ = d.text_words(pa.array([f"{item} x y z {item}"]))
    assert index.matches(hashes) == [(1, 0, 10, 0, 1.0)]
