"""Quality classifier: votes of the nearest labelled documents in a latent semantic space.

A document's terms are its words and the shapes of its text (runs of three characters, each
as one of eight classes), hashed into fixed numbers of columns, and its rates of repetition.
The latent space is the truncated singular value decomposition of the labelled sample. The
labelled vectors are broadcast: ``PER_CLASS`` a class at most, so their size is bounded.
Every document is compared with all of them by exact cosine products, in blocks, and its
``NEIGHBOURS`` nearest vote, weighted by a power of the similarity.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revolva.llm import labelled, text
from revolva.llm.session import prepare

#: Labelled documents of each class that are learned, at most.
PER_CLASS = 1500
DIMENSIONS = 48
NEIGHBOURS = 7
POWER = 16
THRESHOLD = 0.3
#: Similarity that an undecided vote counts, so that documents unlike all others stay near it.
DOUBT = 0.02
BLOCK = 256

_WORDS, _SHAPES, _RATES = 2048, 512, 8
TERMS = _WORDS + _SHAPES + _RATES


def _classes() -> np.ndarray:
    """Class of each byte: upper, lower, digit, blank, line end, stop, other sign, symbol."""
    out = np.ones(256, np.uint16)
    for c in range(128):
        sign = chr(c)
        if sign.isalpha():
            out[c] = 0 if sign.isupper() else 1
        elif sign.isdigit():
            out[c] = 2
        elif sign in "\n\r":
            out[c] = 4
        elif sign.isspace():
            out[c] = 3
        elif sign in ".,":
            out[c] = 5
        elif sign in "!?;:'\"()-":
            out[c] = 6
        else:
            out[c] = 7
    return out


_CLASS = _classes()


def terms(column: pa.Array) -> np.ndarray:
    """Term weights of each text, a row of unit length for each group of terms."""
    out = np.zeros((len(column), TERMS), np.float32)
    for row, end, raw, bounds in text.pieces(column):
        hashes, first = text.words(raw, bounds)
        kinds = _CLASS[raw]
        for i in range(end - row):
            own = hashes[first[i] : first[i + 1]]
            shape = kinds[bounds[i] : bounds[i + 1]]
            if not len(shape):
                continue
            line = out[row + i]
            count = np.bincount((shape[:-2] * 64 + shape[1:-1] * 8 + shape[2:]).astype(np.int64), minlength=_SHAPES)
            line[_WORDS : _WORDS + _SHAPES] = np.sqrt(count)
            if len(own):
                line[:_WORDS] = np.log1p(np.bincount((own % np.uint64(_WORDS)).astype(np.int64), minlength=_WORDS))
                again = float((own[1:] == own[:-1]).mean()) if len(own) > 1 else 0.0
                fresh = len(np.unique(own)) / len(own)
                rates = [again, fresh, min(1.0, len(shape) / len(own) / 20)]
            else:
                rates = [0.0, 0.0, 1.0]
            rates.append(float((shape == 0).mean()))
            line[_WORDS + _SHAPES :] = [x for r in rates for x in (r, 1 - r)]
            for a, b, weight in ((0, _WORDS, 0.5), (_WORDS, _WORDS + _SHAPES, 1.0), (_WORDS + _SHAPES, TERMS, 1.0)):
                line[a:b] *= weight / max(1e-9, float(np.linalg.norm(line[a:b])))
    return out


class Model:
    """Projection into the latent space, and the labelled vectors in it."""

    def __init__(self, projection: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.projection, self.vectors, self.labels = projection, vectors, labels

    def latent(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.projection
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among the nearest; a text like none of them gets a half."""
        near = self.latent(x) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        if not k:
            return np.full(len(x), 0.5)
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(float) ** POWER
        return ((weight * self.labels[top]).sum(1) + DOUBT / 2) / (weight.sum(1) + DOUBT)


def decompose(x: np.ndarray, dimensions: int) -> np.ndarray:
    """Leading right singular vectors, by subspace iteration from a fixed start."""
    start = np.random.default_rng(7).normal(size=(x.shape[1], dimensions + 16)).astype(np.float32)
    basis = np.linalg.qr(start)[0]
    for _ in range(6):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
    return np.ascontiguousarray((basis @ turn.T)[:, :dimensions], np.float32)


def _sparse(batches):
    for batch in batches:
        x = terms(batch.column(2))
        at, value = [], []
        for line in x:
            where = np.flatnonzero(line)
            at.append(where.astype("<u2").tobytes())
            value.append(line[where].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(at, pa.binary()), pa.array(value, pa.binary())], ["doc_id", "label", "at", "value"]
        )


def train(documents: DataFrame, labels: DataFrame, learnable: Column, per_class: int = PER_CLASS) -> Model:
    """Learn from at most ``per_class`` documents of each label; without any, all scores are a half."""
    prepare(documents.sparkSession)
    chosen = labelled.texts(documents, labelled.sample(labels, "quality", learnable, per_class))
    # Bounded: two classes of at most ``per_class`` rows of non-zero terms.
    rows = chosen.mapInArrow(_sparse, "doc_id long, label int, at binary, value binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.at, r.value))
    x = np.zeros((len(rows), TERMS), np.float32)
    for line, r in zip(x, rows):
        line[np.frombuffer(r.at, "<u2")] = np.frombuffer(r.value, "<f4")
    projection = decompose(x, DIMENSIONS) if len(rows) else np.zeros((TERMS, DIMENSIONS), np.float32)
    model = Model(projection, np.zeros((0, DIMENSIONS), np.float32), np.array([r.label for r in rows], float))
    model.vectors = model.latent(x)
    return model


def _scored(column: pa.Array, model: Model) -> np.ndarray:
    parts = [model.scores(terms(column.slice(at, BLOCK))) for at in range(0, len(column), BLOCK)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _score(batches, model):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scored(batch.column(1), model.value))], ["doc_id", "score"])


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row (doc_id, text), from the whole text alone.

    A null or empty text has the score a half. A null doc_id stays null, a repeated row is a
    row again, an empty table gives no rows. Other columns are ignored.
    """
    spark = documents.sparkSession
    prepare(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(partial(_score, model=spark.sparkContext.broadcast(model)), "doc_id long, score double")


def _keep(batches, model, place: int, threshold: float):
    for batch in batches:
        yield batch.filter(pa.array(_scored(batch.column(place), model.value) >= threshold))


def stage(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` without the rows that score below ``threshold``."""
    spark = documents.sparkSession
    prepare(spark)
    keep = partial(_keep, model=spark.sparkContext.broadcast(model), place=documents.columns.index("text"), threshold=threshold)
    return documents.mapInArrow(keep, documents.schema)
