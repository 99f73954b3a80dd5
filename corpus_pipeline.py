"""From raw documents to packed training sequences, in stages that each give a table for the next.

Every stage but the last returns the columns of ``documents``: it takes rows out or changes
their text. The last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revolva.llm import decontamination, labelled, neardup, packing, quality, secrets, tokens
from revolva.llm.session import stored, table

#: SQL has no words for the classifier, so the pipeline is tested against brute force.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), labelled.fold(F.col("doc_id"), 5) != 0)
    return quality.stage(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words to a shingle, a similarity of 0.8.

    Rows without doc_id and rows that repeat one are compared like any others.
    """
    return neardup.stage(docs, unnamed=True)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.stage(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their text replaced."""
    return secrets.stage(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, packed into sequences."""
    return packing.packed(docs, tokens.vocabulary())


STAGES = [
    ("quality classifier", keep_good),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("secret scan", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
