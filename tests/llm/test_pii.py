"""Personal data: patterns as given, and what the field adds."""

import hashlib
import random
import re

import numpy as np
import pytest
from helpers import clashing, documents, odd_rows

from revolva.llm import pii, queries
from revolva.llm.secrets import ordered

# The patterns in their plain form.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def holds(kind, text):
    digits = re.sub(r"[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if holds(kind, m[0])]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


@pytest.fixture(scope="module")
def weights(spark, medium_dir):
    return pii.trained(spark.read.parquet(f"{medium_dir}/documents.parquet"))


def test_base_spans_are_those_of_the_plain_patterns(spark, medium_dir):
    random.seed(2)
    parts = ["a", "x.y", "@", "@", ".", ".com", "-", "+", " ", "(", ")", "0", "255", "256", "4111111111111111", "79927398713", "1.2.3.4", "é", "+1 (988) 555-2485", "٣"]
    for _ in range(6000):
        text = "".join(random.choices(parts, k=random.randint(1, 14)))
        assert ordered(pii.base_spans(text), pii.KINDS) == plain(text), text
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{medium_dir}/documents.parquet").collect()}
    rows = queries.op9_personal_data(spark, medium_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        spans = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in PLAIN)
        assert set(filter(None, spans.split(","))) <= set(r.spans.split(","))


def test_distant_mentions_get_the_label_of_a_sure_one(weights):
    filler = " the words of between" * 200
    text = f"pay with 4111111111111111 now.{filler} the same 4111.1111.1111.1111 again"
    base = pii.base_spans(text)
    assert [k for k, _, _ in base] == ["card"]
    at = text.index("4111.")
    assert pii.added_spans(text, base, weights) == [("card", at, at + 19)]
    phone = f"call +1 (988) 555-2485.{filler} or 988-555-2485, ok"
    at = phone.index("988-555")
    assert ("phone", at, at + 12) in pii.added_spans(phone, pii.base_spans(phone), weights)


def test_clean_numbers_are_left_alone(weights):
    for text in ("version 2.0. of 1999, page 12", "section 3.1. of 5", "no digits at all", "", "year 2024 and 2024 and 2024"):
        assert pii.added_spans(text, pii.base_spans(text), weights) == []


def test_messages_give_exact_marginals_on_a_tree():
    rng = np.random.default_rng(3)
    field = pii.Field("1 2 3 x 1", [])
    assert sorted(map(tuple, field.edges.tolist())) == [(0, 1, 0), (0, 3, 1), (1, 2, 0)]
    k = len(pii.LABELS)
    pair = rng.normal(size=(2, k, k))
    weights = pii.Weights(rng.normal(size=(pii.FEATURES, k)), pair + pair.transpose(0, 2, 1))
    own = field.x() @ weights.unary
    joint = np.zeros((k,) * 4)
    for labels in np.ndindex(joint.shape):
        joint[labels] = sum(own[i, v] for i, v in enumerate(labels)) + sum(weights.pair[t, labels[a], labels[b]] for a, b, t in field.edges)
    joint = np.exp(joint - joint.max())
    joint /= joint.sum()
    want = [joint.sum(axis=tuple(j for j in range(4) if j != i)) for i in range(4)]
    assert np.allclose(pii.beliefs(field, weights, 200), want, atol=2e-3)


def test_long_runs_take_linear_time(weights):
    for text in ("1" * 200_000, "1." * 100_000, "+" * 100_000 + "1", "@" * 100_000, "a@" * 50_000, "a" * 200_000 + "@", "9 " * 50_000):
        base = pii.base_spans(text)
        pii.added_spans(text[:40_000], [s for s in base if s[2] <= 40_000], weights)


def test_odd_rows(spark, weights):
    df = clashing(documents(spark, odd_rows() + [(60, "me@example.com")]))
    rows = pii.personal_data(df).collect()
    assert len(rows) == df.count()
    assert [r.spans for r in rows if r.doc_id == 60] == ["email:0:14"]
    assert all(r.spans == "" for r in rows if r.doc_id != 60)
    assert pii.personal_data(documents(spark, [])).count() == 0


def test_counted_rows_fit_like_repeated_ones():
    rng = np.random.default_rng(2)
    k = len(pii.LABELS)
    x = np.hstack([np.ones((40, 1)), rng.integers(0, 2, (40, pii.FEATURES - 1))]).astype(float)
    near, y, counts = rng.integers(0, 3, (40, 2 * k)).astype(float), rng.integers(0, k, 40), rng.integers(1, 6, 40)
    counted = pii.fit(x, near, y, counts.astype(float))
    single = pii.fit(*(np.repeat(v, counts, axis=0) for v in (x, near, y)), np.ones(counts.sum()))
    assert np.allclose(counted.unary, single.unary, atol=1e-6) and np.allclose(counted.pair, single.pair, atol=1e-6)


def test_many_addresses_in_a_text_take_time_in_proportion():
    import time

    def seconds(n):
        text = " ".join(f"user{i}@mail{i % 7}.example.com" for i in range(n))
        base = pii.base_spans(text)
        start = time.process_time()
        field = pii.Field(text, base)
        assert len(base) == n and (field.labels >= 0).sum() == n
        return time.process_time() - start

    seconds(500)
    assert seconds(40_000) < 12 * max(seconds(10_000), 0.02)
