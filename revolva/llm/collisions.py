"""Approximate nearest neighbours by counting collisions of single projections.

Vectors are put on the unit sphere, where the largest cosine is the smallest distance, and
projected on ``PROJECTIONS`` random lines. The index holds, for each line, the projections
of a segment's rows as a sorted array. For a query the window around its own projection is
as wide as the present radius asks; rows inside collide with the query on that line. The
windows grow by virtual rehashing: the next radius only reads the two new ends of each
window, and counts go on from where they were. A row that collides on at least
``threshold`` lines is verified by its exact cosine on the original vector.

A query is done with a segment when its k-th best verified distance is within the radius.
At that radius a row at exactly that distance collides on a line with the chance of a
standard normal value within ``HALF_WIDTH``, so the count is binomial, and the threshold
lies ``DEVIATIONS`` standard deviations below its mean: such a row is missed with a chance
of about 2 %, a nearer one with less. The last radius holds all rows, so a query always
finds as many rows as there are.

Every row is indexed, in segments of at most ``SEGMENT`` rows that are built where the
rows are read; nothing is fitted on a sample. No candidate is dropped. Queries go in blocks
of about ``BLOCK`` rows that are broadcast; what a query's block already holds is a first
bound for its radius.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revolva.llm import vectors as V
from revolva.llm.session import prepare, stored

BLOCK = 2048
SEGMENT = 8192
PROJECTIONS = 96
#: Half a window's width, as a multiple of the radius.
HALF_WIDTH = 0.8
#: The chance that a standard normal value is within HALF_WIDTH.
COLLISION = 0.5762892
DEVIATIONS = 2.0
#: First radius, and the factor from one radius to the next.
FIRST_RADIUS = 0.1
GROWTH = 1.05
SEED = 7
#: More than single precision can err in a cosine.
ROUNDING = 1e-4

_FOUND = "query_id long, vec_id long, score double"


def radii() -> np.ndarray:
    """Radii of virtual rehashing; two points of the sphere are at most 2 apart, the last is boundless."""
    steps = int(np.ceil(np.log(2 / FIRST_RADIUS) / np.log(GROWTH)))
    return np.append(FIRST_RADIUS * GROWTH ** np.arange(steps), np.inf)


def threshold(lines: int) -> int:
    return max(1, int(lines * COLLISION - DEVIATIONS * np.sqrt(lines * COLLISION * (1 - COLLISION))))


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, which changes no cosine and keeps squares in range."""
    most = np.max(np.abs(rows), axis=1, initial=0, keepdims=True)
    return np.ldexp(rows, -np.frexp(most)[1])


def _lines(width: int, lines: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((lines, width))


def _norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(axis=1))


class _Block:
    """Queries of a block as they are broadcast; ``bounds`` are upper bounds of the k-th distances."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, lines: int, seed: int):
        self.ids, self.rows, self.k = ids, _scaled(rows), k
        self.norms = _norms(self.rows)
        self.lines = _lines(rows.shape[1], lines, seed)
        unit = self.rows / self.norms[:, None]
        self.unit = unit.astype(np.float32)
        self.projected = unit @ self.lines.T
        self.bounds = np.full(len(ids), np.inf)
        if len(ids) > k:
            for at in range(0, len(ids), 256):
                near = unit[at : at + 256] @ unit.T
                near[np.arange(len(near)), at + np.arange(len(near))] = -np.inf
                kth = -np.partition(-near, k - 1, axis=1)[:, k - 1]
                self.bounds[at : at + 256] = np.sqrt(np.maximum(0, 2 - 2 * kth))


class Segment:
    """Sorted projections of at most ``SEGMENT`` rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, lines: np.ndarray):
        self.ids, self.rows = ids, rows
        self.norms = _norms(rows)
        unit = rows / self.norms[:, None]
        self.unit = unit.astype(np.float32)
        values = lines @ unit.T
        order = np.argsort(values, axis=1, kind="stable")
        # All lines in one ascending array: each is moved beyond the one before.
        self.step = 4 * (np.abs(values).max() + 1)
        self.base = np.arange(len(lines)) * self.step
        self.values = (np.take_along_axis(values, order, axis=1) + self.base[:, None]).ravel()
        self.order = order.astype(np.uint16).ravel()
        self.ends = np.arange(len(lines) + 1) * len(ids)

    def window(self, centre: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each line's window, as places in the whole array."""
        edge = self.step / 4
        low = np.maximum(centre - half, -edge) + self.base
        high = np.minimum(centre + half, edge) + self.base
        return np.searchsorted(self.values, low), np.searchsorted(self.values, high, "right")

    def collided(self, parts: list[np.ndarray]) -> np.ndarray:
        return np.bincount(np.concatenate(parts), minlength=len(self.ids))


def _search(batches, block):
    b: _Block = block.value
    best = V.Best(len(b.ids), b.k)
    steps, enough = radii(), threshold(len(b.lines))
    bounds = b.bounds.copy()
    for batch in V.chunks(batches, SEGMENT):
        rows = _scaled(V.matrix(batch.column(1), b.rows.shape[1]))
        ids = np.asarray(batch.column(0))
        some = rows.any(axis=1)
        if not some.any():
            continue
        segment = Segment(ids[some], rows[some], b.lines)
        for q in range(len(b.ids)):
            bounds[q] = _expand(b, q, segment, best, bounds[q], steps, enough)
    q, score, vec = best.entries()
    yield pa.RecordBatch.from_arrays(
        [pa.array(b.ids[q], pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())],
        ["query_id", "vec_id", "score"],
    )


def _expand(b: _Block, q: int, segment: Segment, best: V.Best, bound: float, steps: np.ndarray, enough: int) -> float:
    """Grow the windows of one query in one segment; gives the bound of its k-th distance."""
    centre = b.projected[q]
    counts = np.zeros(len(segment.ids), np.int64)
    open_ = segment.ids != b.ids[q]
    low = high = None
    for radius in steps[np.searchsorted(steps, min(bound, 2.0)) if np.isfinite(bound) else 0 :]:
        new_low, new_high = segment.window(centre, HALF_WIDTH * radius)
        if low is None:
            low, high = new_low, new_low
        spans = zip(new_low.tolist(), low.tolist(), high.tolist(), new_high.tolist())
        counts += segment.collided([segment.order[x:y] for a, c, d, e in spans for x, y in ((a, c), (d, e)) if x < y] or [segment.order[:0]])
        low, high = new_low, new_high
        at = np.nonzero((counts >= enough) & open_)[0]
        if len(at):
            open_[at] = False
            # A cosine in single precision leaves out what is clearly below the k best; the rest is exact.
            least = max(best.scores[q, -1], 1 - bound * bound / 2)
            at = at[segment.unit[at] @ b.unit[q] >= least - ROUNDING]
            score = (segment.rows[at] * b.rows[q]).sum(axis=1) / (segment.norms[at] * b.norms[q])
            best.add(np.full(len(at), q), score, segment.ids[at])
        kth = best.scores[q, -1]
        if kth > -np.inf:
            bound = min(bound, float(np.sqrt(max(0.0, 2 - 2 * kth))))
        if bound <= radius:
            break
    return bound


def nearest(
    vectors: DataFrame, is_query: str, k: int = 5, lines: int = PROJECTIONS, block: int = BLOCK, seed: int = SEED
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k rows of largest cosine that are found.

    Queries are the rows of ``vectors`` (vec_id, embedding) that the SQL condition ``is_query``
    on vec_id names; a row is no candidate of a query with its id. Scores are cosines of the
    original vectors in double precision, ties go to the smaller vec_id, and a query with at
    most k candidates gets all of them.

    Rows take no part if vec_id or the vector is null, if a component is null, NaN or infinite,
    or if all are zero. Vectors of unequal length meet as if filled with zeros. A repeated row
    is a candidate each time; a repeated query is asked once (the greater vector, if they
    differ). An empty table gives no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    valid = V.finite(vectors).where(F.exists("embedding", lambda x: x != 0))
    asked = valid.where(is_query).groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
    width = valid.agg(F.max(F.size("embedding"))).first()[0] or 0
    found: list[DataFrame] = []
    for mine in V.blocks(asked, block) if width else ():
        ids = np.array([r.vec_id for r in mine], np.int64)
        rows = V.matrix(V.as_lists([r.embedding for r in mine]), width)
        sent = spark.sparkContext.broadcast(_Block(ids, rows, k, lines, seed))
        found.append(_first(valid.mapInArrow(partial(_search, block=sent), _FOUND), k))
    if len(found) > 1:
        found = [stored(x, "nearest") for x in found]
    every = reduce(DataFrame.unionByName, found) if found else _first(spark.createDataFrame([], _FOUND), k)
    return every.select("query_id", "rank", "vec_id", "score")


def _first(entries: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
