"""Hard negatives by exact inner products in a residue number system.

Scores are inner products of whole-number vectors. Each matrix of components is reduced
modulo several primes below 1,024, centred on zero, so a product of 64 columns stays below
2**24 in magnitude and single-precision matrix multiplication is exact, in any order of
its sums. Wider vectors are multiplied 64 columns at a time and reduced in between. The
signed score is put together from its residues by Chinese remaindering in mixed radix with
centred digits. There are as many primes as the largest possible score asks for.

Positives of an anchor are its best rows of the same label, and hard negatives its best
rows of another label whose scores lie in a band below the positive's: two passes over
the rows, each of which keeps the best of a task and picks the best of all by a window.
"""

from __future__ import annotations

import math
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revolva.llm import vectors as V
from revolva.llm.session import prepare, stored

#: Anchors to a broadcast block, and rows that meet a block at once (16 MB for a matrix of scores).
BLOCK = 1024
ROWS = 2048
#: Columns whose products of centred residues cannot leave the whole numbers of single precision.
COLUMNS = 64
_LARGEST = 1023
#: Scores below this times a hundred are whole numbers of double precision.
_DOUBLE = 1 << 46

_POSITIVES = "anchor_id long, positive_id long, positive_score long"
_NEGATIVES = "anchor_id long, positive int, positive_id long, positive_score long, negative_id long, negative_score long"


def primes(bound: int) -> list[int]:
    """The greatest primes below 1,024 whose product is more than four times ``bound``."""
    found: list[int] = []
    candidate = _LARGEST
    while math.prod(found) <= 4 * bound:
        if candidate < 3:
            raise ValueError("scores are too large for residues of ten bits")
        if all(candidate % d for d in range(2, math.isqrt(candidate) + 1)):
            found.append(candidate)
        candidate -= 1
    return found


def _centred(m: np.ndarray, p: int) -> np.ndarray:
    """Residues of whole numbers in single precision, about zero."""
    return m - np.float32(p) * np.rint(m * np.float32(1 / p))


class Residues:
    """A matrix of whole numbers as one matrix of residues per prime."""

    def __init__(self, rows: np.ndarray, moduli: list[int]):
        self.moduli = moduli
        # fmod is exact for doubles of any size.
        self.planes = [_centred(np.fmod(rows, p).astype(np.float32), p) for p in moduli]

    def products(self, other: Residues, large: bool) -> np.ndarray:
        """Exact inner products with the rows of another matrix, as doubles or as Python's integers."""
        digits: list[np.ndarray] = []
        for i, p in enumerate(self.moduli):
            a, b = self.planes[i], other.planes[i]
            rest = np.zeros((len(a), len(b)), np.float32)
            for at in range(0, a.shape[1], COLUMNS):
                rest = _centred(rest + _centred(a[:, at : at + COLUMNS] @ b[:, at : at + COLUMNS].T, p), p)
            # Mixed radix: take known digits off and divide by their primes, modulo p.
            for digit, q in zip(digits, self.moduli):
                inverse = pow(q, -1, p)
                rest = _centred((rest - digit) * np.float32(inverse if inverse <= p // 2 else inverse - p), p)
            digits.append(rest)
        kind = object if large else float
        whole = (lambda m: np.frompyfunc(int, 1, 1)(m)) if large else (lambda m: m.astype(float))
        total = whole(digits[-1])
        for digit, p in zip(digits[-2::-1], self.moduli[-2::-1]):
            total = total * p + whole(digit)
        return total.astype(kind, copy=False)


class _Block:
    """Anchors as they are broadcast."""

    def __init__(self, ids, labels, rows: np.ndarray, scale: int, bound: int):
        self.ids, self.labels, self.scale, self.width = ids, labels, scale, rows.shape[1]
        self.large = bound >= _DOUBLE
        self.moduli = primes(bound)
        self.planes = Residues(rows, self.moduli)

    @property
    def kind(self):
        return object if self.large else float

    def meet(self, batches):
        """(ids, whether the label is the anchor's, whether the id is the anchor's, scores) of some rows."""
        for batch in V.chunks(batches, ROWS):
            rows = np.floor(self.scale * V.matrix(batch.column(1), self.width))
            ids, labels = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            scores = self.planes.products(Residues(rows, self.moduli), self.large)
            yield ids, self.labels[:, None] == labels, self.ids[:, None] == ids, scores


def _long(values) -> pa.Array:
    return pa.array([int(x) for x in values], pa.int64())


def _find_positives(batches, block, k: int):
    b: _Block = block.value
    best = V.Best(len(b.ids), k, b.kind)
    for ids, same, own, scores in b.meet(batches):
        best.offer(np.where(same & ~own, scores, -np.inf), ids)
    q, score, vec = best.entries()
    yield pa.RecordBatch.from_arrays(
        [_long(b.ids[q]), _long(vec), _long(score)], ["anchor_id", "positive_id", "positive_score"]
    )


def _find_negatives(batches, block, positives, k: int, low: int, high: int):
    b: _Block = block.value
    place, ids_of, score_of = positives.value
    best = [V.Best(len(b.ids), k, b.kind) for _ in range(place)]
    for ids, same, own, scores in b.meet(batches):
        hundredfold = scores * 100
        for j in range(place):
            p = score_of[:, j : j + 1]
            fits = ~same & ~own & (low * p <= hundredfold) & (hundredfold <= high * p)
            if fits.any():
                best[j].offer(np.where(fits, scores, -np.inf), ids)
    for j in range(place):
        q, score, vec = best[j].entries()
        yield pa.RecordBatch.from_arrays(
            [
                _long(b.ids[q]),
                pa.array(np.full(len(q), j + 1), pa.int32()),
                _long(ids_of[q, j]),
                _long(score_of[q, j]),
                _long(vec),
                _long(score),
            ],
            ["anchor_id", "positive", "positive_id", "positive_score", "negative_id", "negative_score"],
        )


def _first(entries: DataFrame, keys: list[str], score: str, vec: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), vec)
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    is_anchor: str,
    positives: int = 5,
    negatives: int = 3,
    scale: int = 256,
    low: int = 50,
    high: int = 95,
    block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Anchors are the rows of ``vectors`` (vec_id, embedding, label) that the SQL condition
    ``is_anchor`` on vec_id names. A component x counts as floor(``scale`` * x), and scores are
    inner products; higher ones come first, ties go to the smaller vec_id. An anchor's
    positives are its best ``positives`` other rows of the same label. For each of them the
    best ``negatives`` rows of another label are given whose score is between ``low`` and
    ``high`` percent of the positive's score; fewer, if there are fewer.

    Rows take no part if vec_id, label or the vector is null or a component is null, NaN or
    infinite. Vectors of unequal length meet as if filled with zeros. A repeated row is a
    candidate each time, rows with the anchor's own id never are, and a repeated anchor is
    asked once (the greatest vector and label, if they differ). An empty table gives no
    rows. Scores beyond 64 bits are an error.
    """
    spark = vectors.sparkSession
    prepare(spark)
    valid = V.finite(vectors, F.col("label").cast("long").alias("label")).where(F.col("label").isNotNull())
    anchors = valid.where(is_anchor).groupBy("vec_id").agg(F.max(F.struct("embedding", "label")).alias("row")).select("vec_id", "row.*")
    sizes = valid.agg(
        F.max(F.size("embedding")).alias("width"),
        F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x)))).alias("reach"),
    ).first()
    width = sizes.width or 0
    reach = int(float(sizes.reach or 0) * scale) + 1
    found: list[DataFrame] = []
    for some in V.blocks(anchors, block) if width else ():
        ids = np.array([r.vec_id for r in some], np.int64)
        labels = np.array([r.label for r in some], np.int64)
        rows = np.floor(scale * V.matrix(V.as_lists([r.embedding for r in some]), width))
        mine_ = _Block(ids, labels, rows, scale, width * reach * reach)
        sent = spark.sparkContext.broadcast(mine_)
        near = valid.mapInArrow(partial(_find_positives, block=sent, k=positives), _POSITIVES)
        # At most ``positives`` rows for each anchor of the block.
        best = _first(near, ["anchor_id"], "positive_score", "positive_id", positives).collect()
        sent_positives = spark.sparkContext.broadcast(_table(mine_, best, positives))
        entries = valid.mapInArrow(
            partial(_find_negatives, block=sent, positives=sent_positives, k=negatives, low=low, high=high), _NEGATIVES
        )
        found.append(_first(entries, ["anchor_id", "positive"], "negative_score", "negative_id", negatives))
    if len(found) > 1:
        found = [stored(x, "negatives") for x in found]
    empty = _first(spark.createDataFrame([], _NEGATIVES), ["anchor_id", "positive"], "negative_score", "negative_id", negatives)
    every = reduce(DataFrame.unionByName, found) if found else empty
    return every.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _table(block: _Block, best: list, positives: int):
    """Ids and scores of each anchor's positives as matrices; a score of NaN fits no negative."""
    at = {int(v): i for i, v in enumerate(block.ids)}
    ids = np.zeros((len(at), positives), np.int64)
    scores = np.full((len(at), positives), np.nan, block.kind)
    for r in best:
        ids[at[r.anchor_id], r.rank - 1] = r.positive_id
        scores[at[r.anchor_id], r.rank - 1] = r.positive_score
    return positives, ids, scores
