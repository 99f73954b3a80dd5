"""Near-duplicate detection: multi-index Hamming join on b-bit MinHash signatures.

A signature holds the lowest ``BITS`` bits of ``POSITIONS`` MinHash values. It is split
into ``CHUNKS`` chunks. If two signatures differ in at most ``DISTANCE`` positions, then
some chunk differs in at most ``ERRORS`` of them, since
``DISTANCE < CHUNKS * (ERRORS + 1)``. So a key is made of each chunk for each choice of
``ERRORS`` positions left out, and two such signatures share a key for certain. At a
similarity of exactly 0.8 a pair is beyond the distance about once in a million.

Texts with the same shingle set form a class, and only one of them goes on. In each key's
bucket, all members are compared with one hub, the member that meets most others over all
its keys (no pairs within a bucket are listed). What remains are pairs of a bucket whose
members are still in different components. A shingle that no other of the remaining texts
has cannot be shared, which bounds the similarity of a text to any other; pairs within
this exact bound are compared as well. So no link between components is lost. Links are
confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revolva.llm import text
from revolva.llm.components import components
from revolva.llm.session import prepare, stored

BITS = 16
POSITIONS = 48
CHUNKS = 12
ERRORS = 1
DISTANCE = CHUNKS * (ERRORS + 1) - 1

_WIDTH = POSITIONS // CHUNKS
_SIGNATURES = "doc_id long, n long, high long, low long, signature binary"
_KEYS = "key long, id long, n long"


def _sets(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text of the second column."""
    for row, end, raw, bounds in text.pieces(batch.column(1)):
        hashes, first = text.words(raw, bounds)
        for i in range(end - row):
            yield row + i, np.unique(text.shingles(hashes[first[i] : first[i + 1]], shingle))


def _signatures(batches, shingle: int):
    factors = text.numbers(POSITIONS, 21) | np.uint64(1)
    masks = text.numbers(POSITIONS, 22)
    for batch in batches:
        ids, sizes, high, low, signs = batch.column(0), [], [], [], []

        def close(held: list[np.ndarray]) -> None:
            every = np.concatenate(held)
            starts = np.concatenate([[0], np.cumsum([len(h) for h in held])[:-1]]).astype(np.int64)
            high.extend(np.add.reduceat(text.mix(every), starts).astype(np.int64).tolist())
            low.extend(np.add.reduceat(text.mix(every ^ masks[0]), starts).astype(np.int64).tolist())
            least = np.empty((len(held), POSITIONS), np.uint64)
            for k in range(POSITIONS):
                np.minimum.reduceat((every ^ masks[k]) * factors[k], starts, out=least[:, k])
            short = text.mix(least).astype("<u2")
            signs.extend(s.tobytes() for s in short)

        held: list[np.ndarray] = []
        count = 0
        rows: list[int] = []
        for row, members in _sets(batch, shingle):
            sizes.append(len(members))
            if len(members):
                held.append(members)
                rows.append(row)
                count += len(members)
            if count > 50_000:
                close(held)
                held, count = [], 0
        if held:
            close(held)
        place = {row: k for k, row in enumerate(rows)}
        at = [place.get(row) for row in range(batch.num_rows)]
        pick = lambda values: [None if k is None else values[k] for k in at]
        yield pa.RecordBatch.from_arrays(
            [
                ids.cast(pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(pick(high), pa.int64()),
                pa.array(pick(low), pa.int64()),
                pa.array(pick(signs), pa.binary()),
            ],
            ["doc_id", "n", "high", "low", "signature"],
        )


def _keys(batches):
    kept = list(combinations(range(_WIDTH), _WIDTH - ERRORS))
    tags = text.numbers(CHUNKS * len(kept), 23).reshape(CHUNKS, len(kept))
    for batch in batches:
        if not batch.num_rows:
            continue
        signs = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").reshape(-1, CHUNKS, _WIDTH).astype(np.uint64)
        keys = np.empty((len(signs), CHUNKS, len(kept)), np.uint64)
        for j, lanes in enumerate(kept):
            value = np.zeros(signs.shape[:2], np.uint64)
            for lane in lanes:
                value = (value << np.uint64(BITS)) | signs[:, :, lane]
            keys[:, :, j] = text.mix(text.mix(value) ^ tags[:, j])
        each = CHUNKS * len(kept)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys.reshape(-1).astype(np.int64)),
                pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), each)),
                pa.array(np.repeat(batch.column(1).to_numpy(zero_copy_only=False), each)),
            ],
            ["key", "id", "n"],
        )


def _full_sets(batches, shingle: int):
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for row, members in _sets(batch, shingle):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[row]], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(members)], pa.int32()), pa.array(members.astype(np.int64))),
                ],
                ["id", "members"],
            )


def _alike(a: str, b: str, percent: int) -> str:
    """Sizes that allow the similarity."""
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _near(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs within the signature distance."""
    left = signatures.select(F.col("id").alias("a"), F.col("signature").alias("sa"))
    right = signatures.select(F.col("id").alias("b"), F.col("signature").alias("sb"))

    def apart(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, POSITIONS) for k in (2, 3))
                near = (a != b).sum(1) <= DISTANCE
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near)) for k in (0, 1)], ["a", "b"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return joined.mapInArrow(apart, "a long, b long")


def full_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(id, members) of the texts of ``ids`` (id). The list of ids grows with the corpus: it is never broadcast."""
    wanted = ids.select(F.col("id").alias("doc_id")).distinct().hint("merge")
    found = docs.join(wanted, "doc_id", "left_semi")
    return stored(found.mapInArrow(partial(_full_sets, shingle=shingle), "id long, members array<long>"), "sets")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= ``percent`` * union of their full shingle sets."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b"
    )
    shared = F.size(F.array_intersect("ma", "mb"))
    return both.where(100 * shared >= percent * (F.size("ma") + F.size("mb") - shared)).select("a", "b")


def _shareable(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """``mixed`` with the number of each text's shingles that another text of ``mixed`` has."""
    ids = mixed.select("id").distinct()
    each = sets.join(ids, "id", "left_semi").select("id", F.explode("members").alias("shingle"))
    alone = each.groupBy("shingle").agg(F.min("id").alias("id"), F.count("*").alias("texts")).where("texts = 1")
    alone = alone.groupBy("id").agg(F.count("*").alias("alone"))
    return mixed.join(alone, "id", "left").withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0)))


def _across(undecided: DataFrame, percent: int) -> DataFrame:
    """Links between texts of one hub that are in different components so far.

    Pairs are compared inside the join, first by the bound and then in full, so that only
    links are rows. Both sides are shuffled by the hub and hot hubs can be split.
    """
    a, b = undecided.alias("a"), undecided.alias("b")
    most, shared = "least(a.common, b.common)", "size(array_intersect(a.members, b.members))"
    alike = " and ".join(
        [
            "a.hub = b.hub and a.label < b.label",
            f"100 * {most} >= {percent} * (a.n + b.n - {most})",
            f"100 * {shared} >= {percent} * (a.n + b.n - {shared})",
        ]
    )
    return a.join(b, F.expr(alike)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text with fewer
    words than ``shingle`` is one shingle. Texts without words (null, empty, blank) link
    with nothing. A row without doc_id links with nothing, has no component and is kept.
    Rows that repeat an id are copies under that id: each has the component of its text.
    Other columns are ignored. The result of an empty table is empty.
    """
    prepare(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(docs.mapInArrow(partial(_signatures, shingle=shingle), _SIGNATURES), "signatures")
    classes = stored(
        signed.where("n > 0 and doc_id is not null")
        .groupBy("high", "low", "n")
        .agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature")),
        "classes",
    )
    keys = classes.select("id", "n", "signature").mapInArrow(_keys, _KEYS)
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    star = stored(keys.join(shared, "key"), "stars")
    weights = star.groupBy("id").agg(F.sum("size").alias("weight"))
    hubs = star.join(weights, "id").groupBy("key").agg(F.min(F.struct(-F.col("weight"), "id", "n")).alias("hub"))
    star = stored(star.join(hubs.select("key", "hub.id", "hub.n").toDF("key", "hub", "hub_n"), "key"), "stars")
    sets = full_sets(docs, star, shingle)

    around = star.where("id <> hub").where(_alike("n", "hub_n", percent)).select(F.col("id").alias("a"), F.col("hub").alias("b"))
    links = stored(confirm(_near(around.distinct(), classes), sets, percent), "links")
    labels = components(links)

    labelled = star.join(labels.withColumnRenamed("node", "id"), "id", "left").select(
        "key", "id", "n", "hub", F.coalesce("component", "id").alias("label")
    )
    split = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    mixed = labelled.join(split, "key", "left_semi").where("id <> hub").select("hub", "id", "n", "label").distinct()
    undecided = _shareable(stored(mixed, "mixed"), sets).where(F.col("common") * 100 >= F.col("n") * percent)
    more = stored(_across(stored(undecided.join(sets, "id"), "undecided"), percent), "links")
    if not more.isEmpty():
        labels = components(links.union(more))

    named = stored(
        classes.join(labels.withColumnRenamed("node", "id"), "id", "left").select(
            "high", "low", "n", F.coalesce("component", "id").alias("component_id")
        ),
        "named",
    )
    found = signed.select("doc_id", "high", "low", "n").join(named, ["high", "low", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def stage(documents: DataFrame, shingle: int = 5, percent: int = 80, unnamed: bool = False) -> DataFrame:
    """``documents`` with the first row of each group of near copies: the one with the smallest id.

    Rows are told apart by a number of their own, so of rows that repeat id and text one
    stays, and texts that share an id are judged each. Rows without doc_id come last in
    their group if ``unnamed``; else they take no part and stay. So do texts without words.
    """
    rows = stored(documents.withColumn("_row", F.monotonically_increasing_id()), "rows")
    part = rows if unnamed else rows.where("doc_id is not null")
    found = near_duplicates(part.select(F.col("_row").alias("doc_id"), "text"), shingle, percent)
    grouped = found.select(F.col("doc_id").alias("_row"), "component_id").join(part.select("_row", F.col("doc_id").alias("_id")), "_row")
    first = grouped.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("first"))
    copies = part.select("_row").join(first.select("first._row"), "_row", "left_anti")
    return rows.join(copies, "_row", "left_anti").select(*documents.columns)
