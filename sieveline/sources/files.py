"""Single files on any file system that Spark can open: read, written by rename, hashed as a stream."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Bytes handed over at a time.
CHUNK = 1 << 20


def _at(spark: SparkSession, path: str):
    """The path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def size(spark: SparkSession, path: str) -> int:
    at, fs = _at(spark, path)
    return fs.getFileStatus(at).getLen()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    at, fs = _at(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def sha256(spark: SparkSession, path: str) -> str:
    """The checksum of one file, read as a stream by the driver's JVM: memory does not depend on its size."""
    at, fs = _at(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


class _Sink(io.RawIOBase):
    """What is written goes to a Java stream."""

    def __init__(self, stream):
        self.stream = stream

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(bytearray(data))
        return len(data)


@contextmanager
def writer(spark: SparkSession, path: str) -> Iterator[io.BufferedWriter]:
    """A binary file that takes the place of ``path`` when it is whole; nothing changes if the block fails."""
    sc = spark.sparkContext
    at, fs = _at(spark, path)
    part, _ = _at(spark, f"{path.rpartition('/')[0] or '.'}/.{at.getName()}.{uuid.uuid4().hex}")
    stream = fs.create(part, True)
    try:
        with io.BufferedWriter(_Sink(stream), CHUNK) as out:
            yield out
        stream.close()
    except BaseException:
        stream.close()
        fs.delete(part, False)
        raise
    rename = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
    over = sc._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(at), over)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    with writer(spark, path) as out:
        out.write(text.encode())
