"""Personal data by patterns and a skip-chain conditional random field.

Spans of the four patterns are always reported. The field labels what the patterns miss:
its nodes are the tokens of a document that hold a digit or "@" (all other tokens are
outside by definition). Neighbouring nodes are joined by chain edges. Nodes that repeat a
text, or the last seven digits, of an earlier node are joined to its last occurrence by a
skip edge, however far apart, so a document has fewer than three edges a node. Tokens in a
span have that label for certain; loopy message passing carries it along both kinds of
edges. A token whose label is then likely enough, and is in no span, is added.

The weights of tokens and edges are fitted together by pseudo-likelihood on the patterns'
spans in a bounded sample of documents (``SAMPLE``, chosen by hash).
"""

from __future__ import annotations

import hashlib
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revolva.llm import labelled
from revolva.llm.secrets import Span, joined, ordered
from revolva.llm.session import prepare

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["", *KINDS]
#: Documents that the weights are fitted on.
SAMPLE = 4000
#: Least probability of an added token.
LEAST = 0.9
ROUNDS = 30

# The patterns, the email one in two parts.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
_DIGITS = re.compile(r"[0-9]+")
_EDGE_SIGNS = "()[]{}<>\"',;:!?."


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    found, end, last, at = [], 0, -1, text.find("@")
    while at >= 0:
        before = text[max(end, last + 1) : at]
        local = len(before) - len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if local else None
        if domain:
            end = domain.end()
            found.append((at - local, end))
        last, at = at, text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns, leftmost and without overlap for each kind."""
    found: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if not _DIGITS.search(text):
        return found
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return found


def features(token: str) -> list[float]:
    """What a token looks like."""
    digits = "".join(_DIGITS.findall(token))
    core = token.strip(_EDGE_SIGNS)
    parts = core.split(".")
    n, letters = len(digits), sum(c.isalpha() for c in token)
    amounts = [n == 0, 1 <= n <= 3, 4 <= n <= 6, 7 <= n <= 8, 9 <= n <= 11, 12 <= n <= 15, 16 <= n <= 19, n > 19]
    shape = [
        "@" in token,
        "@" in token and "." in core.rpartition("@")[2],
        token.startswith("+"),
        "(" in token or ")" in token,
        "-" in core,
        core.count(".") == 1,
        core.count(".") == 2,
        core.count(".") == 3,
        len(parts) == 4 and all(p.isdigit() and len(p) <= 3 for p in parts),
        "." in core and all(p.isdigit() for p in parts),
        letters > 0,
        letters > n,
        core.isdigit(),
        12 <= n <= 19 and luhn(digits),
        "=" in token or ":" in core or "/" in core,
    ]
    return [1.0, *map(float, amounts), *map(float, shape)]


FEATURES = len(features("0"))


class Field:
    """Nodes and edges of one document."""

    def __init__(self, text: str, base: list[Span]):
        self.spans = [m.span() for m in _TOKEN.finditer(text)]
        self.tokens = [text[a:b] for a, b in self.spans]
        self.labels = np.full(len(self.spans), -1)
        at, held = 0, sorted(base, key=lambda s: s[1:])
        for i, (a, b) in enumerate(self.spans):
            while at < len(held) and held[at][2] <= a and held[at][1] <= a:
                at += 1
            for k in range(at, len(held)):
                kind, x, y = held[k]
                if x >= b:
                    break
                if y > a and self.labels[i] < 0:
                    self.labels[i] = LABELS.index(kind)
        edges, last = [], {}
        for i, token in enumerate(self.tokens):
            if i and text[self.spans[i - 1][1] : self.spans[i][0]].isspace():
                edges.append((i - 1, i, 0))
            digits = "".join(_DIGITS.findall(token))
            keys = {("text", token.strip(_EDGE_SIGNS).lower())} | ({("digits", digits[-7:])} if len(digits) >= 7 else set())
            for j in {last[k] for k in keys if k in last}:
                edges.append((j, i, 1))
            last.update(dict.fromkeys(keys, i))
        self.edges = np.array(edges, np.int64).reshape(-1, 3)

    def x(self) -> np.ndarray:
        return np.array([features(t) for t in self.tokens]).reshape(len(self.tokens), FEATURES)

    def neighbours(self, labels: np.ndarray) -> np.ndarray:
        """How many neighbours over each kind of edge have each label."""
        out = np.zeros((len(self.tokens), 2 * len(LABELS)))
        for a, b in ((0, 1), (1, 0)):
            np.add.at(out, (self.edges[:, a], self.edges[:, 2] * len(LABELS) + labels[self.edges[:, b]]), 1)
        return out


class Weights:
    """Token weights (features x labels) and symmetric edge weights (kind, label, label)."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair


#: Expected weight of equal labels at both ends of a skip edge, before any data.
SKIP_PRIOR = 6.0


def fit(x: np.ndarray, near: np.ndarray, y: np.ndarray, counts: np.ndarray, rounds: int = 400, ridge: float = 0.3) -> Weights:
    """Maximum pseudo-likelihood: each label given the token and the labels of its neighbours.

    A row stands for as many equal tokens as ``counts`` says.

    A token with a skip edge is also learned with its looks hidden, so that the edge does not
    leave all to the looks. Weights are drawn to the prior: zero, but for equal labels over
    skip edges.
    """
    k = len(LABELS)
    prior = np.zeros((FEATURES + 2 * k, k))
    prior[FEATURES + k :] = np.diag([0.0] + [SKIP_PRIOR] * (k - 1))
    blind = near[:, k:].sum(1) > 0
    hidden = np.zeros((int(blind.sum()), FEATURES))
    every = np.concatenate([np.concatenate([x, near], axis=1), np.concatenate([hidden, near[blind]], axis=1)])
    y, counts = np.concatenate([y, y[blind]]), np.concatenate([counts, counts[blind]])
    w = prior.copy()
    moment, square = np.zeros_like(w), np.zeros_like(w)
    target = np.eye(k)[y]
    for step in range(1, rounds + 1 if len(y) else 1):
        p = every @ w
        p = np.exp(p - p.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        slope = (every.T @ ((p - target) * counts[:, None]) + ridge * (w - prior)) / counts.sum()
        moment, square = 0.9 * moment + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        w -= 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    pair = w[FEATURES:].reshape(2, k, k)
    return Weights(w[:FEATURES], (pair + pair.transpose(0, 2, 1)) / 2)


def beliefs(field: Field, weights: Weights, rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities of every node by loopy sum-product, damped by half."""
    own = field.x() @ weights.unary
    own -= own.max(1, keepdims=True)
    sure = np.flatnonzero(field.labels >= 0)
    own[sure] = -50.0
    own[sure, field.labels[sure]] = 0.0
    source = np.concatenate([field.edges[:, 0], field.edges[:, 1]])
    target = np.concatenate([field.edges[:, 1], field.edges[:, 0]])
    pair = weights.pair[np.concatenate([field.edges[:, 2]] * 2)]
    half = len(field.edges)
    back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
    messages = np.zeros((2 * half, len(LABELS)))
    for _ in range(rounds if half else 0):
        total = own.copy()
        np.add.at(total, target, messages)
        sent = (total[source] - messages[back])[:, :, None] + pair
        top = sent.max(1)
        new = top + np.log(np.exp(sent - top[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        change = np.abs(new - messages).max()
        messages = (messages + new) / 2
        if change < 1e-3:
            break
    total = own.copy()
    np.add.at(total, target, messages)
    total = np.exp(total - total.max(1, keepdims=True))
    return total / total.sum(1, keepdims=True)


def added_spans(text: str, base: list[Span], weights: Weights, least: float = LEAST) -> list[Span]:
    """Tokens outside all base spans whose label is likely; adjacent ones of a kind are one span."""
    field = Field(text, base)
    if not len(field.spans) or (field.labels >= 0).all():
        return []
    belief = beliefs(field, weights)
    label = belief.argmax(1)
    new = (field.labels < 0) & (label > 0) & (belief.max(1) >= least)
    joint = {int(b) for _, b, kind in field.edges if kind == 0}
    spans: list[Span] = []
    for i in np.flatnonzero(new).tolist():
        token, (a, b) = field.tokens[i], field.spans[i]
        a += len(token) - len(token.lstrip(_EDGE_SIGNS))
        b -= len(token) - len(token.rstrip(_EDGE_SIGNS))
        if a >= b:
            continue
        kind = LABELS[label[i]]
        if spans and i in joint and new[i - 1] and label[i - 1] == label[i] and spans[-1][2] >= field.spans[i - 1][0]:
            spans[-1] = kind, spans[-1][1], b
        else:
            spans.append((kind, a, b))
    return spans


def _train(batches):
    for batch in batches:
        rows: list[list[float]] = []
        for text in batch.column(0).to_pylist():
            field = Field(text or "", base_spans(text or ""))
            if len(field.tokens):
                labels = np.maximum(field.labels, 0)
                rows += np.concatenate([field.x(), field.neighbours(labels), labels[:, None]], axis=1).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], ["row"])


def trained(documents: DataFrame, sample: int = SAMPLE) -> Weights:
    """Weights from at most ``sample`` documents, those with the smallest hash of their id."""
    prepare(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # At most ``sample`` ids.
    ids = labelled.some(docs.select("doc_id"), sample)
    rows = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("text").mapInArrow(_train, "row array<double>")
    # Equal tokens are counted where they are: what comes back are the different looks of tokens.
    groups = rows.groupBy("row").count().collect()
    every = np.array(sorted([*r.row, r["count"]] for r in groups), float).reshape(-1, FEATURES + 2 * len(LABELS) + 2)
    return fit(every[:, :FEATURES], every[:, FEATURES:-2], every[:, -2].astype(int), every[:, -1])


def _scan(batches, weights: Weights):
    for batch in batches:
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        digests, every = [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = ordered(base_spans(text), KINDS)
            for kind, values in counts.items():
                values.append(sum(k == kind for k, _, _ in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            more = added_spans(text, base, weights) if base or _DIGITS.search(text) or "@" in text else []
            every.append(joined(ordered(base + more, KINDS)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(v, pa.int64()) for v in counts.values()), pa.array(digests, pa.string()), pa.array(every, pa.string())],
            ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
        )


def personal_data(documents: DataFrame, weights: Weights | None = None) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans), spans (all).

    Counts and digest are of the base spans. Spans are kind:start:end in code points, by
    start, then kind. Whole texts are scanned; a null or empty text has none. A null doc_id
    stays null and takes no part in the fit, a repeated row is a row again, an empty table
    gives no rows. Other columns are ignored. Weights are fitted on ``documents`` if not given.
    """
    prepare(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fitted = weights or trained(documents)
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.mapInArrow(partial(_scan, weights=fitted), f"doc_id long, {counts}, base_sha256 string, spans string")
