"""Files beside tables, in any file system that Spark can reach: listings and small files that appear whole."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: name below the folder, bytes, time of the last change in milliseconds
File = tuple[str, int, int]


def _open(spark: SparkSession, path: str):
    """(file system, path) on the JVM."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _open(spark, path)
    return fs.exists(where)


def listing(spark: SparkSession, path: str) -> list[File]:
    """All data files below a folder, or the file itself; names that begin with _ or . are left out."""
    fs, where = _open(spark, path)
    if not fs.exists(where):
        raise FileNotFoundError(path)
    root = fs.getFileStatus(where).getPath().toUri().getPath().rstrip("/")
    found, files = [], fs.listFiles(where, True)
    while files.hasNext():
        status = files.next()
        name = status.getPath().toUri().getPath()[len(root) :].lstrip("/")
        if not any(part[:1] in ("_", ".") for part in name.split("/")):
            found.append((name, status.getLen(), status.getModificationTime()))
    return sorted(found)


def read(spark: SparkSession, path: str) -> str:
    fs, where = _open(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str, replace: bool = False) -> bool:
    """Make a small file appear whole under a name. Without ``replace``, False if the name is taken.

    The text is written under a name of its own and renamed, which either happens or does not.
    """
    fs, where = _open(spark, path)
    own = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}-{uuid.uuid4().hex}")
    stream = fs.create(own, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE if replace else kind.NONE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(own), fs.makeQualified(where), how)
    except Exception as error:
        fs.delete(own, False)
        if "FileAlreadyExists" in str(error):
            return False
        raise
    return True


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _open(spark, path)
    fs.delete(where, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Give a folder or file another name in the same file system, which is not taken."""
    fs, where = _open(spark, path)
    if not fs.rename(where, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} cannot be moved to {to}")
