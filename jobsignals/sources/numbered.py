"""Numbers that several writers take in turn, and small files that appear whole.

A number is taken by creating a file that must not exist yet, which file systems decide for one writer
only. A small file is written beside its place and renamed, so that a reader sees all of it or nothing.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, at = _open(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def take(spark: SparkSession, path: str) -> bool:
    """Create an empty file; false if it is there, whoever made it."""
    fs, at = _open(spark, path)
    fs.mkdirs(at.getParent())
    if fs.getUri().getScheme() == "file":  # Hadoop's local file system looks first and creates then
        return spark._jvm.java.io.File(at.toUri().getPath()).createNewFile()
    try:
        fs.create(at, False).close()
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    return True


def next_number(spark: SparkSession, folder: str, least: int = 0) -> int:
    """Take the number after the greatest one in ``folder``, at least ``least``.

    A writer that fails afterwards leaves a gap; no number is given twice.
    """
    while True:
        taken = [int(n) for n in names(spark, folder) if n.isdigit()]
        number = max([least - 1, *taken]) + 1
        if take(spark, f"{folder}/{number}"):
            return number


def put(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _open(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{uuid.uuid4().hex}")
    stream = fs.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.rename(beside, at):
        raise OSError(f"cannot write {path}")


def get(spark: SparkSession, path: str) -> str:
    fs, at = _open(spark, path)
    stream = fs.open(at)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _open(spark, path)
    fs.delete(at, True)
