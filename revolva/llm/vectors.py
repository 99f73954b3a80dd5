"""Vectors of a table as rows of matrices, and the rows of a query set in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(vectors: DataFrame, *others: str) -> DataFrame:
    """vec_id (long), embedding (array of doubles) and ``others`` of the rows that take part.

    Rows without vec_id or vector, or with a null or non-finite component, are left out.
    """
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), *others
    ).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole)


def matrix(values: pa.Array, width: int) -> np.ndarray:
    """Lists of doubles as rows, shorter ones filled with zeros, longer ones cut to ``width``."""
    sizes = np.diff(np.asarray(values.offsets))
    flat = np.asarray(values.flatten(), float)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[at < width], at[at < width]] = flat[at < width]
    return out


def as_lists(rows: list) -> pa.Array:
    return pa.array(rows, pa.list_(pa.float64()))


def chunks(batches, rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a task in record batches of ``rows`` rows, the last one shorter."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        while count + batch.num_rows >= rows:
            held.append(batch.slice(0, rows - count))
            batch = batch.slice(rows - count)
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, count = [], 0
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
    if count:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def blocks(asked: DataFrame, size: int) -> Iterator[list]:
    """The rows of a query set with unique vec_id, in blocks of about ``size`` by a hash of the id."""
    count = max(1, -(-asked.count() // size))
    for number in range(count):
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(count)) == number).orderBy("vec_id").collect()
        if mine:
            yield mine


class Best:
    """The k best (score, id) of each of some queries: higher scores first, ties to smaller ids."""

    def __init__(self, queries: int, k: int, kind=float):
        self.scores = np.full((queries, k), -np.inf, kind)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` of all queries against rows ``ids``; -inf is no candidate."""
        k = self.scores.shape[1]
        if scores.shape[1] > k:
            kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        else:
            kth = np.full(len(scores), -np.inf)
        least = np.maximum(kth, self.scores[:, -1])[:, None]
        q, r = np.nonzero((scores >= least) & (scores > -np.inf))
        if len(q):
            self.add(q, scores[q, r], ids[r])

    def add(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Single entries, ``q`` the number of the query."""
        k = self.scores.shape[1]
        touched = np.unique(q)
        q = np.concatenate([q, np.repeat(touched, k)])
        scores = np.concatenate([scores, self.scores[touched].ravel()])
        ids = np.concatenate([ids, self.ids[touched].ravel()])
        order = np.lexsort((ids, -scores, q))
        q, scores, ids = q[order], scores[order], ids[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        first = place < k
        self.scores[q[first], place[first]] = scores[first]
        self.ids[q[first], place[first]] = ids[first]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, id) of all that are held."""
        q, j = np.nonzero(self.scores > -np.inf)
        return q, self.scores[q, j], self.ids[q, j]
