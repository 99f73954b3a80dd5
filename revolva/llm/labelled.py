"""Folds and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_LOTS = 1 << 40


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % folds


def sample(labels: DataFrame, column: str, learnable: Column, per_class: int) -> DataFrame:
    """(doc_id, label): at most ``per_class`` ids of each class 0 and 1, those with the smallest hash.

    An id that is labelled more than once counts with its smallest label; null ids and
    labels other than 0 and 1 are ignored. Of a class of many ids, only those below a hash
    that about twice as many as needed reach are ranked, so the ranking does not grow.
    """
    each = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & learnable)
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .withColumn("lot", F.pmod(F.xxhash64("doc_id"), F.lit(_LOTS)))
    )
    sizes = dict(each.groupBy("label").count().collect())
    few = F.lit(False)
    for label, n in sizes.items():
        enough = min(_LOTS, _LOTS * (2 * per_class + 100) // n)
        few = few | ((F.col("label") == label) & (F.col("lot") < enough))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("lot", "doc_id"))
    return each.where(few).withColumn("rank", rank).where(F.col("rank") <= per_class).select("doc_id", "label")


def some(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of the distinct doc_id, those with the smallest hash; the ranking does not grow."""
    each = ids.where("doc_id is not null").withColumn("lot", F.pmod(F.xxhash64("doc_id"), F.lit(_LOTS)))
    enough = min(_LOTS, _LOTS * (2 * most + 100) // max(1, each.count()))
    return each.where(F.col("lot") < enough).distinct().orderBy("lot", "doc_id").limit(most).select("doc_id")


def texts(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, label, text) of a bounded sample, one row a doc_id; ``chosen`` is broadcast, as its size has a fixed bound.

    An id that several rows carry counts with its smallest text.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = docs.join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))
