"""Exact top-k inner products by a three-phase uniform threshold.

The score of a query and a vector is a sum over slices of the components, so each slice is
a list of local scores, as if kept on a node of its own:

1. Every slice gives its k best local scores to each query. The exact totals of the vectors
   met so far give a lower bound of the k-th best score.
2. If a vector's total reaches that bound, then a local score reaches the uniform share of it:
   bound / slices. Each slice gives all local scores from the share on.
3. Vectors whose known local scores plus the share for each unknown one reach the bound are
   resolved exactly, and the k best are kept.

Local scores may be negative; the argument holds for any sign. No score that could count is
left out: entries equal to the bound stay.

Queries are taken in blocks of at most ``BLOCK`` rows, which are broadcast: a stated query
set against all rows. Within a task a block meets all rows of a batch in one matrix product
for each slice. Scores are exact integers: products are taken in doubles as long as no sum can
reach 2**52, and otherwise in Python's integers.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revolva.llm.session import prepare, stored

#: Queries to a broadcast block.
BLOCK = 4096
SLICES = 2
#: Rows that meet a block of queries at once.
ROWS = 2048


def _matrix(values: pa.Array, width: int, scale: int) -> np.ndarray:
    """Scaled whole-number vectors as rows, shorter ones filled with zeros."""
    sizes = np.diff(np.asarray(values.offsets))
    flat = np.floor(np.asarray(values.flatten()) * scale)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray, large: bool) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers."""
    if not large:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return whole(a) @ whole(b).T


def _slices(width: int, count: int) -> list[slice]:
    edges = [width * i // count for i in range(count + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:]) if a < b]


class _Block:
    """A block of queries, as it is broadcast."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, slices: int, scale: int, large: bool):
        self.ids, self.vectors, self.scale, self.large = ids, vectors, scale, large
        self.slices = _slices(vectors.shape[1], slices)

    def meet(self, batches):
        """(row ids, where a row is the query's own, local scores by slice)."""
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                rows = _matrix(some.column(1), self.vectors.shape[1], self.scale)
                ids = np.asarray(some.column(0))
                own = self.ids[:, None] == ids[None, :]
                yield ids, own, [_products(self.vectors[:, s], rows[:, s], self.large) for s in self.slices]


def _entries(query, vec, local) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array([int(x) for x in local], pa.int64())],
        ["query_id", "vec_id", "score"],
    )


def _local_lists(batches, block, k: int):
    """Phase 1: of the vectors in some slice's list of k best, the k best totals of a task."""
    b: _Block = block.value
    best = np.full((len(b.ids), k), -np.inf, object if b.large else float)
    names = np.zeros((len(b.ids), k), np.int64)
    for ids, own, local in b.meet(batches):
        chosen = np.zeros(own.shape, bool)
        for scores in local:
            scores = np.where(own, -np.inf, scores)
            top = np.argpartition(-scores, min(k, len(ids)) - 1, axis=1)[:, :k]
            np.put_along_axis(chosen, top, True, axis=1)
        total = np.where(chosen & ~own, sum(local[1:], local[0]), -np.inf)
        every = np.concatenate([best, total], axis=1)
        top = np.argpartition(-every, k - 1, axis=1)[:, :k]
        best = np.take_along_axis(every, top, axis=1)
        names = np.take_along_axis(np.concatenate([names, np.broadcast_to(ids, total.shape)], axis=1), top, axis=1)
    q, j = np.nonzero(best > -np.inf)
    yield _entries(b.ids[q], names[q, j], best[q, j])


def _sufficient(batches, block, bound, k: int):
    """Phases 2 and 3: entries from the uniform share on, bounded by the shares of the rest, then resolved."""
    b: _Block = block.value
    least = np.array(bound.value, object if b.large else float)
    share = least / len(b.slices)
    for ids, own, local in b.meet(batches):
        known = [scores >= share[:, None] for scores in local]
        q, v = np.nonzero(reduce(np.logical_or, known) & ~own)
        most = sum(np.where(given[q, v], scores[q, v], share[q]) for given, scores in zip(known, local))
        q, v = q[most >= least[q]], v[most >= least[q]]
        total = sum(scores[q, v] for scores in local)
        enough = total >= least[q]
        q, v, total = q[enough], v[enough], total[enough]
        # More than k of one batch cannot all count, however many are equal.
        order = np.lexsort((ids[v], -total, q))
        q, v, total = q[order], v[order], total[order]
        few = np.arange(len(q)) - np.searchsorted(q, q) < k
        yield _entries(b.ids[q[few]], ids[v[few]], total[few])


def _valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, whole-number components) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite
    )


def _best(entries: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: str, k: int = 10, scale: int = 1024, slices: int = SLICES, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of ``vectors`` (vec_id, embedding) to each query.

    Queries are the rows that the SQL condition ``is_query`` on vec_id names; a row is no
    candidate of a query with its id. A component x counts as floor(``scale`` * x). Ties go
    to the smaller vec_id. Rows take no part if vec_id or the vector is null or a component
    is null, NaN or infinite. Vectors of unequal length meet as if filled with zeros. A
    repeated row is a candidate each time, and a repeated query is asked once (the greater
    vector, if they differ). An empty table gives no rows. Scores beyond 64 bits are an error.
    """
    spark = vectors.sparkSession
    prepare(spark)
    valid = _valid(vectors)
    asked = valid.where(is_query).groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
    blocks = max(1, -(-asked.count() // block))
    sizes = valid.agg(
        F.max(F.size("embedding")).alias("width"),
        F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x)))).alias("reach"),
    ).first()
    width, reach = sizes.width or 0, float(sizes.reach or 0) * scale + 1
    large = reach * reach * max(1, width) >= 1 << 52
    schema = "query_id long, vec_id long, score long"
    found = [spark.createDataFrame([], schema)]
    for number in range(blocks if width else 0):
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).orderBy("vec_id").collect()
        if not mine:
            continue
        lists = pa.array([r.embedding for r in mine], pa.list_(pa.float64()))
        ids = np.array([r.vec_id for r in mine], np.int64)
        sent = spark.sparkContext.broadcast(_Block(ids, _matrix(lists, width, scale), slices, scale, large))
        lower = _best(valid.mapInArrow(partial(_local_lists, block=sent, k=k), schema), k)
        # One row for each query of the block; a query with fewer than k candidates takes all.
        kth = lower.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
        bounds = {r.query_id: r.least for r in kth.collect()}
        bound = spark.sparkContext.broadcast([bounds.get(int(i), -np.inf) for i in ids])
        enough = valid.mapInArrow(partial(_sufficient, block=sent, bound=bound, k=k), schema)
        found.append(stored(_best(enough, k).select("query_id", "vec_id", "score"), "best") if blocks > 1 else enough)
    every = reduce(DataFrame.unionByName, found)
    return _best(every, k).select("query_id", "rank", "vec_id", "score")
