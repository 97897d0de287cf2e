"""Helpers shared by the corpus operators: tables, shared folders, Arrow text buffers.

Every operator reads only the columns it names, so further columns, whatever
they are called, never change a result.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
ASCII_SPACE = "\t\n\x0b\x0c\r "


#: Rows, and bytes, that Python workers get at a time, where the session says nothing else: long texts are kept from piling up.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "16777216"}


def light_batches(spark: SparkSession) -> None:
    for key, value in ARROW_BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    light_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset: the warehouse, or, if all of Spark is in this process, a
    temporary folder that goes with it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.partition("[")[0] == "local":
            found = tempfile.mkdtemp(prefix="sessionlake-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.sparkContext.setCheckpointDir(found)
    return found


class _Made(threading.local):
    """Folders that this thread has made for intermediate tables, in order; other threads' queries keep theirs."""

    def __init__(self):
        self.paths: list[str] = []


_MADE = _Made()


def scratch(spark: SparkSession, name: str) -> str:
    _MADE.paths.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE.paths[-1]


def made() -> int:
    return len(_MADE.paths)


def fresh(taken: list[str], name: str) -> str:
    """name, with underscores before it as far as a column is called so already (names differ in more than case)."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete intermediate tables made since a mark (made()), once what was built on them has been written."""
    gone = [p for p in _MADE.paths[since:] if p not in keep]
    _MADE.paths[since:] = [p for p in _MADE.paths[since:] if p in keep]
    for path in gone:
        discard(spark, path)


#: Whether Spark deletes a query's shuffle files as soon as it has ended; else they stay until the driver's garbage is collected.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def no_shuffle_left(spark: SparkSession) -> Iterator[None]:
    """Queries that end in here leave no shuffle files; a DataFrame that is run twice in here makes its shuffles twice."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives a lost executor, leaves no shuffle files."""
    path = scratch(df.sparkSession, name)
    with no_shuffle_left(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def filesystem(spark: SparkSession, path: str):
    """Hadoop FileSystem and Path of a path, whichever store it names."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def discard(spark: SparkSession, path: str) -> None:
    fs, at = filesystem(spark, path)
    fs.delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(c: Column) -> Column:
    """crc32 of an id as text, modulo 5; documents of fold 0 are held out."""
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def text_buffers(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets into them; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
        if isinstance(arr, pa.ChunkedArray):
            arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.large_string())
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    if offsets is None or len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int):
    """Runs [i, j) of documents of about `most` bytes together (a longer document stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: Fixed pseudo-random values that rolling hashes use; any odd multiplier and any table would do.
_MULT = np.uint64(0x9E3779B97F4A7C15)
BYTE_VALUES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)


def inverse(m: int) -> int:
    return pow(m, -1, 2**64)


def powers(n: int, base: int = int(_MULT)) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""

    def of(b: int) -> np.ndarray:
        out = np.full(n, np.uint64(b), np.uint64)
        if n:
            out[0] = 1
        return np.multiply.accumulate(out)

    return of(base), of(inverse(base))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
