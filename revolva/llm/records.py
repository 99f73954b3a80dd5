"""Token ids as length-delimited binary records, with an offset index for reads in any order.

A shard file is a row of records without gaps. A record is

    length of the payload      8 bytes, little-endian
    masked CRC-32 of the length   4 bytes
    payload                    ids of one document, little-endian, 2 or 4 bytes each
    masked CRC-32 of the payload  4 bytes

A masked checksum is the checksum turned right by 15 bits plus 0xA282EAD8, modulo 2**32,
so that a checksum of data that hold checksums stays useful. The index is a Parquet table
of its own: doc_id, shard, offset, length, n_tokens, and the ids before it in the shard.

Documents are put into shards by ranges of doc_id. A shard is written under a name of the
attempt and then renamed, so a task that runs again after a loss replaces the same file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revolva.llm import tokens
from revolva.llm.session import prepare

_INDEX = "doc_id long, shard int, offset long, length long, n_tokens long, before long"
_HEAD = struct.Struct("<QI")
_TAIL = struct.Struct("<I")
#: Bytes read at once when records are read in file order.
READ_AHEAD = 4 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + _TAIL.pack(masked(length)) + payload + _TAIL.pack(masked(payload))


def unframe(record: bytes) -> bytes:
    """The payload of one whole record; ValueError if it is damaged."""
    if len(record) < _HEAD.size + _TAIL.size:
        raise ValueError("a record is cut off")
    length, check = _HEAD.unpack_from(record)
    if masked(record[:8]) != check or length != len(record) - _HEAD.size - _TAIL.size:
        raise ValueError("a record's length is damaged")
    payload = record[_HEAD.size : -_TAIL.size]
    if masked(payload) != _TAIL.unpack_from(record, len(record) - _TAIL.size)[0]:
        raise ValueError("a record's payload is damaged")
    return payload


def _shard(number: int) -> str:
    return f"shard-{number:06d}.rec"


def _write(batches, folder: str, path: str, end_id: int):
    encode = tokens.encoder(path)
    end = np.array([end_id], encode.dtype).tobytes()
    number = TaskContext.get().partitionId()
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    own = f"{base}/.{_shard(number)}.{uuid.uuid4().hex}"
    offset = before = 0
    with store.open_output_stream(own) as out:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            offsets, lengths, counts, befores = [], [], [], []
            for a, b in tokens.blocks(texts):
                for encoded in encode.batch(texts[a:b]):
                    record = frame(encoded + end)
                    out.write(record)
                    n = len(encoded) // encode.dtype.itemsize + 1
                    for values, value in ((offsets, offset), (lengths, len(record)), (counts, n), (befores, before)):
                        values.append(value)
                    offset += len(record)
                    before += n
            yield pa.RecordBatch.from_arrays(
                [
                    ids.cast(pa.int64()),
                    pa.array([number] * len(texts), pa.int32()),
                    *(pa.array(v, pa.int64()) for v in (offsets, lengths, counts, befores)),
                ],
                ["doc_id", "shard", "offset", "length", "n_tokens", "before"],
            )
    store.move(own, f"{base}/{_shard(number)}")


def write_records(documents: DataFrame, folder: str, vocabulary: str, end_id: int = tokens.END_ID, shards: int | None = None) -> None:
    """Encode every whole text, append ``end_id``, and write shards and index below ``folder``.

    Records follow ascending doc_id over all shards; null ids come first, rows that repeat
    an id follow each other. A null or empty text is a record of the end id alone.
    ``folder`` is a URI that driver and executors share; ``shards`` defaults to
    spark.sql.shuffle.partitions. An empty table gives an empty index.
    """
    spark = documents.sparkSession
    prepare(spark)
    count = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
        .repartitionByRange(count, "doc_id", "row")
        .sortWithinPartitions("doc_id", "row")
    )
    written = ordered.select("doc_id", "text").mapInArrow(
        partial(_write, folder=f"{folder}/shards", path=vocabulary, end_id=end_id), _INDEX
    )
    written.write.mode("overwrite").parquet(f"{folder}/index")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index with ``start``, the ids of all documents before."""
    index = spark.read.schema(_INDEX).parquet(f"{folder}/index")
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    # One row per shard.
    before = F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = shards.select("shard", before.alias("base"))
    return index.join(F.broadcast(base), "shard").withColumn("start", F.col("base") + F.col("before")).drop("base")


def _read(batches, folder: str, wide: bool, digest: bool):
    store, base = fs.FileSystem.from_uri(folder)
    shard, file, held, held_at, expected = None, None, b"", 0, -1
    kind = np.dtype("<u4" if wide else "<u2")
    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in ("shard", "offset", "length", "n_tokens")}
        values: list = []
        for number, offset, length, count in zip(*columns.values()):
            if number != shard:
                if file is not None:
                    file.close()
                file, shard, held, held_at, expected = store.open_input_file(f"{base}/{_shard(number)}"), number, b"", 0, -1
            if not held_at <= offset <= offset + length <= held_at + len(held):
                ahead = length if expected not in (offset, -1) else max(length, READ_AHEAD)
                held, held_at = file.read_at(ahead, offset), offset
            expected = offset + length
            ids = np.frombuffer(unframe(held[offset - held_at : offset - held_at + length]), kind)
            if len(ids) != count:
                raise ValueError("a record has another number of ids than the index says")
            values.append(zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int64))
        out = pa.array(values, pa.int64()) if digest else pa.array(values, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), out], ["doc_id", "start", "n_tokens", "ids"])


def read_records(index: DataFrame, folder: str, vocabulary: str, digest: bool = False) -> DataFrame:
    """The records that rows of ``index`` name, in any order: doc_id, start, n_tokens, ids.

    Lengths, checksums and counts are verified. With ``digest``, the last column is
    ids_crc32 instead, the unsigned CRC-32 of the ids as 32-bit integers.
    """
    prepare(index.sparkSession)
    wide = tokens.encoder(vocabulary).wide
    last = "ids long" if digest else "ids array<long>"
    found = index.select("doc_id", "shard", "offset", "length", "n_tokens", "start").mapInArrow(
        partial(_read, folder=f"{folder}/shards", wide=wide, digest=digest), f"doc_id long, start long, n_tokens long, {last}"
    )
    return found.withColumnRenamed("ids", "ids_crc32") if digest else found
