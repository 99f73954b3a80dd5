"""Benchmark decontamination by SimHash windows of the size of each item.

Words are runs of letters and digits, lower-cased. A window of as many words as an item has
slides over every document. A window's fingerprint is the SimHash of its shingles, weighted
by how often each occurs. 64 bits are cut into ``BLOCKS`` blocks: of two fingerprints within
``RADIUS``, some block differs in at most ``RADIUS // BLOCKS`` bits, so the blocks of a window and
an item tell whether the pair is a candidate. Candidates within the radius are confirmed by
the exact weighted similarity of the shingles (sum of minima by sum of maxima).

Such blocks are met by more than half of all items at this radius, so items are looked up by
shingles first, both without loss. The share of a window's shingles that any item has bounds
its similarity to every item, so windows below the threshold there are left out. And a window
that is similar enough holds one of the item's rarest shingles: as many of them as may be
missing, and one more. A document so meets an item only where it holds one of these, however
large the benchmark and however much of it the document holds; pairs are taken in slices.

The radius is a choice: at a similarity of exactly the threshold a window is further away
with a chance of 0.7 (items of 13 words) to 3.3 (long items) in 10,000, at 0.9 of less than one
in a million, and is missed then.

Items go to the tasks in blocks of at most ``ITEMS``, whatever the size of the benchmark; a
block is broadcast and documents are not shuffled.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revolva.llm import text
from revolva.llm.session import prepare

SHINGLE = 5
PERCENT = 80
RADIUS = 20
BLOCKS = 7
#: Items to a broadcast block.
ITEMS = 20_000

#: Pairs of windows and items that are compared at once, and shingles whose bits are counted at once.
PAIRS = 1 << 20
REGION = 1 << 16

_U = np.uint64
_SEEN = 1 << 20


def fingerprints(hashes: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """SimHash of ``count`` shingles from each start: a bit is the majority, a tie is 0."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1)
    total = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=total[1:])
    ones = total[starts + count] - total[starts]
    return np.packbits(2 * ones > count, axis=1).view(_U).ravel()


def fingerprints_at(hashes: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """The same for ascending starts in a text of any length."""
    out, a = np.empty(len(starts), _U), 0
    while a < len(starts):
        b = int(np.searchsorted(starts, starts[a] + REGION))
        low = starts[a]
        out[a:b] = fingerprints(hashes[low : starts[b - 1] + count], starts[a:b] - low, count)
        a = b
    return out


def _splits() -> list[tuple[int, int]]:
    """(lowest bit, bits) of each block."""
    edges = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def compared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether fingerprints meet in a block and lie within the radius, and their distance."""
    differ = a ^ b
    met = np.zeros(differ.shape, bool)
    for low, bits in _splits():
        met |= np.bitwise_count((differ >> _U(low)) & _U((1 << bits) - 1)) <= RADIUS // BLOCKS
    distance = np.bitwise_count(differ).astype(np.int64)
    return met & (distance <= RADIUS), distance


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of minima by sum of maxima of how often each shingle occurs."""
    x, cx = np.unique(a, return_counts=True)
    y, cy = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = int(np.minimum(cx[i], cy[j]).sum())
    return shared / (len(a) + len(b) - shared)


class _Items:
    """Items of one length, their fingerprints, and which of them each rare shingle may lead to."""

    def __init__(self, words: int, members: list[tuple[int | None, np.ndarray]], shingle: int, percent: int):
        self.words, self.members, self.width = words, members, min(words, shingle)
        self.count = words - self.width + 1
        self.prints = np.array([fingerprints(h, np.zeros(1, np.int64), self.count)[0] for _, h in members], _U)
        # A window shares at least this many of an item's shingles, so it has one of the others and one more.
        shared = -(-percent * self.count // 100)
        values, frequency = np.unique(np.concatenate([h for _, h in members]), return_counts=True)
        keys, owners = [], []
        for k, (_, h) in enumerate(members):
            rarest = np.lexsort((h, frequency[np.searchsorted(values, h)]))[: self.count - shared + 1]
            own = np.unique(h[rarest])
            keys.append(own)
            owners.append(np.full(len(own), k))
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]

    def _met(self, found: np.ndarray, starts: np.ndarray, count: int):
        """(window, item) of windows that hold a rare shingle of an item, in slices; some more than once."""
        low, high = int(starts[0]), int(starts[-1]) + count
        first, last = (np.searchsorted(self.keys, found[low:high], side) for side in ("left", "right"))
        at = np.flatnonzero(last > first)
        sizes = (last - first)[at]
        place = at + low
        begin = np.searchsorted(starts, place - count + 1)
        windows = np.searchsorted(starts, place, "right") - begin
        ends = np.cumsum(sizes * windows)
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS)))
            some, wide = sizes[a:b], windows[a:b]
            owner = np.repeat(first[at[a:b]] - np.cumsum(some) + some, some) + np.arange(int(some.sum()))
            each = np.repeat(wide, some)
            item = np.repeat(self.owners[owner], each)
            start = np.repeat(np.repeat(begin[a:b], some) - np.cumsum(each) + each, each)
            yield start + np.arange(len(start)), item
            a = b

    def within(self, found: np.ndarray, starts: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of the pairs within the radius that share a rare shingle."""
        close = [np.zeros(0, np.int64)]
        distances = [np.zeros(0, np.int64)]
        for window, item in self._met(found, starts, count):
            both = np.unique(window * len(self.members) + item)
            window, item = both // len(self.members), both % len(self.members)
            needed, at = np.unique(window, return_inverse=True)
            near, distance = compared(fingerprints_at(found, starts[needed], count)[at], self.prints[item])
            close.append(both[near])
            distances.append(distance[near])
        both, first = np.unique(np.concatenate(close), return_index=True)
        return both // len(self.members), both % len(self.members), np.concatenate(distances)[first]


class Index:
    """A block of items, as it is broadcast."""

    def __init__(self, items: list[tuple[int | None, str | None]], shingle: int, percent: int):
        self.shingle, self.percent = shingle, percent
        by_length: dict[int, list] = {}
        hashes, first = text_words(pa.array([t for _, t in items], pa.string()))
        for k, (name, _) in enumerate(items):
            own = hashes[first[k] : first[k + 1]]
            if len(own):
                by_length.setdefault(len(own), []).append((name, text.shingles(own, shingle)))
        self.lengths = [_Items(n, members, shingle, percent) for n, members in sorted(by_length.items())]
        self.known: dict[int, np.ndarray] = {}
        self.maybe: dict[int, np.ndarray] = {}
        for width in {x.width for x in self.lengths}:
            every = np.unique(np.concatenate([h for x in self.lengths if x.width == width for _, h in x.members]))
            self.known[width] = every
            self.maybe[width] = np.zeros(_SEEN, bool)
            self.maybe[width][every & _U(_SEEN - 1)] = True

    def hits(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of one text and which of them some item has."""
        found = text.shingles(hashes, width)
        hit = self.maybe[width][found & _U(_SEEN - 1)]
        at = np.flatnonzero(hit)
        if len(at):
            known = self.known[width]
            place = np.searchsorted(known, found[at])
            hit[at] = known[np.minimum(place, len(known) - 1)] == found[at]
        return found, hit

    def matches(self, hashes: np.ndarray) -> list[tuple]:
        """(item, start, words, distance, similarity): the best window for each item that the text holds.

        Of windows of equal similarity the one of the smallest distance counts, then the first.
        """
        n = len(hashes)
        best: dict[tuple[int, int], tuple] = {}
        held = {}
        for width in self.known:
            if n:
                found, hit = self.hits(hashes, width)
                if hit.any():
                    held[width] = found, np.concatenate([[0], np.cumsum(hit)])
        for group in self.lengths if held else ():
            if group.width not in held or min(n, self.shingle) < group.width:
                continue
            found, total = held[group.width]
            count = min(group.count, len(found))
            starts = np.arange(len(found) - count + 1)
            enough = 100 * (total[starts + count] - total[starts]) >= self.percent * group.count
            starts = starts[enough]
            if not len(starts):
                continue
            window, item, distance = group.within(found, starts, count)
            for k in np.lexsort((starts[window], distance, item)):
                i, start = int(item[k]), int(starts[window[k]])
                key = group.words, i
                if key in best and best[key][-1] == 1.0:
                    continue
                alike = weighted_similarity(found[start : start + count], group.members[i][1])
                if 100 * alike >= self.percent - 1e-9 and (key not in best or alike > best[key][-1]):
                    words = min(n, group.words)
                    best[key] = group.members[i][0], start, words, int(distance[k]), alike
        return list(best.values())


def text_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a whole column and the first of each text."""
    hashes, firsts = [np.zeros(0, _U)], [np.zeros(1, np.int64)]
    for _, _, raw, bounds in text.pieces(pc.utf8_lower(column)):
        own, first = text.words(raw, bounds, text.PUNCTUATION)
        firsts.append(first[1:] + firsts[-1][-1])
        hashes.append(own)
    return np.concatenate(hashes), np.concatenate(firsts)


def _each(column: pa.Array, index: Index):
    """Matches of each text, in order; texts without any shingle of an item cost little."""
    for row, end, raw, bounds in text.pieces(pc.utf8_lower(column)):
        hashes, first = text.words(raw, bounds, text.PUNCTUATION)
        for i in range(end - row):
            yield row + i, index.matches(hashes[first[i] : first[i + 1]])


def _find(batches, index):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("words", pa.int64()), ("distance", pa.int64()), ("similarity", pa.float64())])
    for batch in batches:
        ids = batch.column(0).to_pylist()
        rows = [(ids[row], *m) for row, found in _each(batch.column(1), index.value) for m in found]
        columns = list(zip(*rows)) or [()] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _clean(batches, index, place: int):
    for batch in batches:
        clean = np.ones(batch.num_rows, bool)
        for row, found in _each(batch.column(place), index.value):
            clean[row] = not found
        yield batch.filter(pa.array(clean))


def _indexes(benchmark: DataFrame, shingle: int, percent: int, items: int):
    """Broadcast blocks of the benchmark, each of a bounded number of items."""
    spark = benchmark.sparkSession
    prepare(spark)
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    held: list[tuple] = []
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        held.append((row.item_id, row.text))
        if len(held) == items:
            yield spark.sparkContext.broadcast(Index(held, shingle, percent))
            held = []
    if held:
        yield spark.sparkContext.broadcast(Index(held, shingle, percent))


def contaminated(
    documents: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, items: int = ITEMS
) -> DataFrame:
    """doc_id, item_id, start, words, distance, similarity: each item that a document holds.

    A document holds an item if some window of the item's number of words (or all of a
    shorter document) has a weighted similarity of ``percent`` or more. The best window is
    given: first word, number of words, fingerprint distance; ties go to the smaller distance,
    then to the first. Items of fewer words than ``shingle`` are one shingle. Every ``items``
    items are one more scan of the documents. Items and texts without words (null, empty, signs only) match
    nothing. A null doc_id or item_id stays null; rows that repeat an id are separate. Empty
    tables give no rows. Other columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, start long, words long, distance long, similarity double"
    found = spark.createDataFrame([], schema)
    for index in _indexes(benchmark, shingle, percent, items):
        found = found.unionByName(docs.mapInArrow(partial(_find, index=index), schema))
    return found


def stage(documents: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``documents`` without the rows that hold an item, as ``contaminated`` finds them.

    Null, empty and wordless texts stay, as do rows without doc_id; repeated rows are decided
    alike; all columns are kept. An empty table or benchmark leaves the rows as they are.
    """
    place = documents.columns.index("text")
    for index in _indexes(benchmark, shingle, percent, ITEMS):
        documents = documents.mapInArrow(partial(_clean, index=index, place=place), documents.schema)
    return documents
