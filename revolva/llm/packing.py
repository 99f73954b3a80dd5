"""Best-fit packing of documents into sequences, improved by a swap-based local search.

Every task tokenizes its documents and cuts those longer than a sequence; only lengths and
checksums of pieces are shuffled. Pieces are dealt at random into groups of about ``GROUP``
and each group is packed on its own: first each piece goes, longest first, to the fullest
bin that has room. Then the emptiest bins are taken apart: a piece moves to another bin, or
is exchanged for a shorter one there, or two pieces are exchanged for one. Each step goes
to a fuller bin and makes it fuller still, so the sum of squared fills grows until the bin
is empty or no step is left. Groups cost one part-filled sequence each at most, so their
size is a trade of memory against one sequence in some thousands.
"""

from __future__ import annotations

import zlib
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revolva.llm import text, tokens
from revolva.llm.session import prepare, stored

CAPACITY = 2048
#: Pieces to a group.
GROUP = 20_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"
_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: only the first may be shorter than a sequence."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def _pieces(batches, path: str, end_id: int, capacity: int):
    encode = tokens.encoder(path)
    end = np.array([end_id], encode.dtype)
    seed, row = TaskContext.get().partitionId() + 1, 0
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: list[tuple] = []
        for a, b in tokens.blocks(texts):
            for doc, encoded in zip(ids[a:b], encode.batch(texts[a:b])):
                values = np.append(np.frombuffer(encoded, encode.dtype), end).astype("<u4")
                for k, (start, length) in enumerate(cut(len(values), capacity)):
                    out.append((doc, k, start, length, zlib.crc32(values[start : start + length].tobytes())))
        deal = text.mix(np.arange(row, row + len(out), dtype=np.uint64) + np.uint64(seed << 40)) >> np.uint64(1)
        row += len(out)
        columns = list(zip(*out)) or [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(deal.astype(np.int64))],
            ["doc_id", "piece", "start", "length", "ids_crc32", "deal"],
        )


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece: longest first, each into the fullest bin with room."""
    bins = np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = made = 0  # bit r of rooms: some bin has room for exactly r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            bin_ = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, bin_, made = capacity, made, made + 1
        bins[i] = bin_
        if room > n:
            open_bins[room - n].append(bin_)
            rooms |= 1 << room - n
    return bins


def improve(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Local search from a packing: moves, one-for-one and two-for-one exchanges towards fuller bins.

    Every underfull bin is tried, the emptiest first, and all of them again once one is
    emptied. It ends at the least possible number of bins, or when no bin can be emptied.
    """
    bins = bins.copy()
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    least = -(-int(lengths.sum()) // capacity)
    used, tried = int((fill > 0).sum()), np.zeros(len(fill), bool)
    while used > least:
        open_ = np.flatnonzero((fill > 0) & (fill < capacity) & ~tried)
        if len(open_) < 2:
            break
        source = int(open_[np.argmin(fill[open_])])
        tried[source] = True
        near = np.flatnonzero((fill[bins] < capacity) & (bins != source))  # pieces of other bins with room
        while fill[source]:
            own = np.flatnonzero(bins == source)
            room = capacity - fill
            best = (0, None)
            target = np.flatnonzero((room > 0) & (fill >= fill[source]))
            target = target[target != source]
            for i in own.tolist():
                n = int(lengths[i])
                fits = target[room[target] >= n]
                if len(fits):
                    to = int(fits[np.argmin(room[fits])])
                    gain = n * (int(fill[to]) - int(fill[source]) + n)
                    best = max(best, (gain, ((i,), None, to)), key=lambda x: x[0])
            if best[1] is None and len(near):
                others, at = lengths[near], bins[near]
                limit, ahead = room[at], fill[at] - fill[source]
                for some in [(i,) for i in own.tolist()] + list(combinations(own.tolist(), 2)):
                    more = int(lengths[list(some)].sum()) - others
                    gain = np.where((more > 0) & (more <= limit) & (ahead >= 0), more * (ahead + more), 0)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (int(gain[k]), (some, int(near[k]), int(at[k])))
            if best[1] is None:
                break
            some, back, to = best[1]
            moved = int(lengths[list(some)].sum()) - (int(lengths[back]) if back is not None else 0)
            bins[list(some)] = to
            if back is not None:
                bins[back] = source
            fill[to] += moved
            fill[source] -= moved
            near = np.flatnonzero((fill[bins] < capacity) & (bins != source))
        if not fill[source]:
            used -= 1
            tried[:] = False
    return bins


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece."""
    whole = lengths == capacity
    bins = np.empty(len(lengths), np.int64)
    parts = lengths[~whole]
    bins[~whole] = improve(parts, best_fit(parts, capacity), capacity) if len(parts) else []
    bins[whole] = (bins[~whole].max() + 1 if len(parts) else 0) + np.arange(int(whole.sum()))
    order = np.lexsort((np.arange(len(lengths)), bins))
    ends = np.cumsum(lengths[order])
    first = np.r_[True, bins[order][1:] != bins[order][:-1]]
    starts = ends - lengths[order]
    offsets = np.empty(len(lengths), np.int64)
    offsets[order] = starts - np.maximum.accumulate(np.where(first, starts, 0))
    return bins, offsets


def _pack_group(key, rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values("deal", kind="stable")
    bins, offsets = pack(rows["length"].to_numpy(np.int64), capacity)
    rows = rows.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)
    return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]


def packed(
    documents: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = tokens.END_ID, group: int = GROUP
) -> DataFrame:
    """Per piece of ``documents`` (doc_id, text): its place among its document's ids and in a sequence.

    Whole texts are encoded and ``end_id`` appended; a null or empty text is the end id
    alone. Rows without doc_id and repeated rows are packed like any others. An empty
    table gives no rows. Other columns are ignored.
    """
    prepare(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = stored(docs.mapInArrow(partial(_pieces, path=vocabulary, end_id=end_id, capacity=capacity), _PIECES), "pieces")
    groups = max(1, -(-pieces.count() // group))
    return (
        pieces.withColumn("pack", F.pmod("deal", F.lit(groups)))
        .groupBy("pack")
        .applyInPandas(partial(_pack_group, capacity=capacity), _PACKED)
    )
