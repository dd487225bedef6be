"""Small files and folders on whatever file system a path names, by Hadoop's interface: local disks, HDFS, object stores."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession


class AlreadyThere(FileExistsError):
    """Another writer has made the file."""


def _fs(spark: SparkSession, path: str):
    """The file system of a path, and the path in its terms."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(str(path))
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def join(base: str, *parts: str) -> str:
    return "/".join([str(base).rstrip("/"), *(str(p).strip("/") for p in parts)])


def name(path: str) -> str:
    return str(path).rstrip("/").rpartition("/")[2]


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder, in order; none if there is no such folder.  Hidden files are left out."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(n for s in fs.listStatus(p) if not (n := s.getPath().getName()).startswith("."))


def files(spark: SparkSession, path: str) -> Iterator[str]:
    """Paths of all files below a folder, in order, or of the file itself."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return
    if fs.getFileStatus(p).isFile():
        yield str(path)
        return
    for n in children(spark, path):
        yield from files(spark, join(path, n))


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def head(spark: SparkSession, path: str, size: int) -> bytes:
    """The first bytes of a file."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    """A whole small file, never seen half written.

    Without ``overwrite`` the file must be new: of several writers one succeeds, the others
    get ``AlreadyThere``.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, target = _fs(spark, path)
    tmp = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(tmp, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE if overwrite else rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(tmp), fs.makeQualified(target), how)
    except Exception as e:
        fs.delete(tmp, False)
        if not overwrite and fs.exists(target):
            raise AlreadyThere(path) from e
        raise


def make(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def copy(spark: SparkSession, source: str, target: str) -> None:
    a, p = _fs(spark, source)
    b, q = _fs(spark, target)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, conf)
