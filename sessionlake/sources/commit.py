"""Numbered files that only one writer can make."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def filesystem(spark: SparkSession, path: str):
    """Hadoop FileSystem and Path of a path, whichever store it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Make the file `path` with this text, as a whole; False if it is there already.

    The text is written beside its place and then renamed.  Where renaming would
    overwrite, as in local folders, a link is made instead, which fails if the
    name is taken.
    """
    fs, at = filesystem(spark, path)
    _, beside = filesystem(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}.tmp")
    stream = fs.create(beside, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        if fs.getUri().getScheme() != "file":
            return not fs.exists(at) and fs.rename(beside, at)
        nio = spark._jvm.java.nio.file
        try:
            nio.Files.createLink(*(nio.Paths.get(fs.makeQualified(p).toUri()) for p in (at, beside)))
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            return False
        return True
    finally:
        fs.delete(beside, False)
