"""Token counts by source, language and tokenizer version, kept up to date by signed changes.

A ledger is a folder. A batch is a small table of signed sums, and a commit file that names
it: written whole, last, and only if the batch has none yet. So a batch counts once, however
often and by however many writers it is committed, and one that broke off does not count.
Totals are the latest snapshot, the totals of many batches in one table, and the batches
after it: inserts, deletes and revised counts need no reread of the documents, and the cost
of a total does not grow with the history.
"""

from __future__ import annotations

import json
import uuid
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revolva.llm import tokens
from revolva.llm.session import prepare
from revolva.sources import files

KEYS = ["source", "lang", "tokenizer"]
_SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"


class Ledger:
    """Additive totals in ``folder``, which driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _names(self, kind: str) -> list[str]:
        path = f"{self.folder}/{kind}"
        listed = files.listing(self.spark, path) if files.exists(self.spark, path) else []
        return [name.removesuffix(".json") for name, _, _ in listed]

    def _entry(self, kind: str, name: str) -> dict:
        return json.loads(files.read(self.spark, f"{self.folder}/{kind}/{name}.json"))

    def _publish(self, kind: str, name: str, entry: dict) -> bool:
        return files.publish(self.spark, f"{self.folder}/{kind}/{name}.json", json.dumps(entry))

    def _snapshot(self) -> tuple[int, dict]:
        """(number, entry) of the latest one; number 0 holds nothing."""
        numbers = self._names("snapshots")
        return (int(max(numbers)), self._entry("snapshots", max(numbers))) if numbers else (0, {"data": None, "batches": []})

    def _write(self, sums: DataFrame, name: str) -> str:
        data = f"{name}/{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.folder}/{data}")
        return data

    def _later(self, snapshot: dict) -> dict[str, str]:
        """Batches after a snapshot, and where their sums are."""
        return {b: self._entry("commits", f"batch={b}")["data"] for b in sorted(set(self.batches()) - set(snapshot["batches"]))}

    def _sums(self, snapshot: dict, later: dict[str, str]) -> DataFrame:
        paths = [f"{self.folder}/{data}" for data in (snapshot["data"], *later.values()) if data]
        every = self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)
        sums = every.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 or tokens <> 0")

    def batches(self) -> list[str]:
        """The names of all committed batches."""
        return [name.removeprefix("batch=") for name in self._names("commits")]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add the signed ``documents`` and ``tokens`` of a batch; False if it was committed before."""
        if not batch or not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch is named by letters, digits, - and _")
        if batch in self.batches():
            return False
        sums = changes.groupBy(*KEYS).agg(
            F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")
        )
        data = self._write(sums, f"batch={batch}")
        if self._publish("commits", f"batch={batch}", {"data": data}):
            return True
        files.remove(self.spark, f"{self.folder}/{data}")  # another writer was first
        return False

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens; keys whose sums are both zero are gone."""
        _, snapshot = self._snapshot()
        return self._sums(snapshot, self._later(snapshot))

    def compact(self) -> bool:
        """Put the totals of all batches so far into a snapshot of the next number; False if another one took it.

        The sums that it holds are removed, so a total that was asked for before must be asked for anew.
        """
        number, snapshot = self._snapshot()
        later = self._later(snapshot)
        if not later:
            return True
        data = self._write(self._sums(snapshot, later), "snapshot")
        entry = {"data": data, "batches": sorted([*snapshot["batches"], *later])}
        if not self._publish("snapshots", f"{number + 1:012d}", entry):
            files.remove(self.spark, f"{self.folder}/{data}")
            return False
        for old in (snapshot["data"], *later.values()):
            if old:
                files.remove(self.spark, f"{self.folder}/{old}")
        return True


def _count(batches, path: str):
    encode = tokens.encoder(path)
    for batch in batches:
        texts = batch.column(2).to_pylist()
        counts: list[int] = []
        for a, b in tokens.blocks(texts):
            counts += [len(x) // encode.dtype.itemsize for x in encode.batch(texts[a:b])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.string()), batch.column(1).cast(pa.string()), pa.array(counts, pa.int64())],
            ["source", "lang", "tokens"],
        )


def counted(documents: DataFrame, vocabulary: str, version: str, sign: int = 1) -> DataFrame:
    """Changes that add (1) or take away (-1) every row of ``documents`` (source, lang, text).

    Whole texts are counted, without special tokens. A null or empty text is a document of
    no tokens. Null sources and languages are keys of their own. Repeated rows count each.
    """
    prepare(documents.sparkSession)
    each = documents.select("source", "lang", "text").mapInArrow(
        partial(_count, path=vocabulary), "source string, lang string, tokens long"
    )
    return each.select(
        "source",
        "lang",
        F.lit(version).alias("tokenizer"),
        F.lit(sign).cast("long").alias("documents"),
        (sign * F.col("tokens")).alias("tokens"),
    )


def estimated(documents: DataFrame, version: str, sign: int = 1) -> DataFrame:
    """As ``counted`` with a quick estimate, a token per four characters, until the exact count is there."""
    guess = F.coalesce(F.floor(F.col("n_chars") / 4), F.lit(0)).cast("long")
    return documents.select(
        "source",
        "lang",
        F.lit(version).alias("tokenizer"),
        F.lit(sign).cast("long").alias("documents"),
        (sign * guess).alias("tokens"),
    )
