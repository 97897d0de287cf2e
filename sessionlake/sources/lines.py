"""Log files as numbered lines, and lines as JSON records.

A line's number is part of an event's identity, so files are read whole and
split in the task that reads them; one file is one row before the split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import local_path

LISTING_SCHEMA = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("mtime", T.DoubleType()), T.StructField("size", T.LongType())])
LINE_SCHEMA = T.StructType([*LISTING_SCHEMA.fields, T.StructField("line_no", T.LongType()), T.StructField("line", T.StringType())])


def listing(spark: SparkSession, folder: str, recursive: bool = False, pattern: str = "*.jsonl") -> DataFrame:
    """file_path, mtime (seconds), size of the files of a folder; contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    meta = reader.load(folder).select("_metadata.file_path", "modificationTime", "length")
    return meta.select(local_path(F.col("file_path")).alias("file_path"), (F.unix_micros("modificationTime") / F.lit(1e6)).alias("mtime"), F.col("length").alias("size"))


def large_enough(files: DataFrame, min_size: int) -> DataFrame:
    return files.filter(F.col("size") >= min_size)


def not_ingested(files: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Files whose key and time the manifest does not have; all of them with force."""
    if force:
        return files
    return files.join(manifest.select(F.col("source_key").alias("file_path"), "mtime"), ["file_path", "mtime"], "left_anti")


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """LINE_SCHEMA: lines that aren't empty, numbered from 1 with the empty ones counted; invalid UTF-8 is replaced."""
    if not paths:
        return spark.createDataFrame([], LINE_SCHEMA)
    whole = spark.read.text(paths, wholetext=True).select(
        local_path(F.col("_metadata.file_path")).alias("file_path"),
        (F.unix_micros("_metadata.file_modification_time") / F.lit(1e6)).alias("mtime"),
        F.col("_metadata.file_size").alias("size"),
        F.make_valid_utf8("value").alias("value"),
    )
    split = whole.select("file_path", "mtime", "size", F.posexplode(F.split("value", "\r\n|\r|\n", -1)).alias("pos", "line"))
    return split.filter(F.trim("line") != "").select("file_path", "mtime", "size", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def records(lines: DataFrame) -> DataFrame:
    """Adds record (variant) and drops lines that hold no JSON object."""
    parsed = lines.withColumn("record", F.try_parse_json("line"))
    return parsed.filter(F.startswith(F.schema_of_variant("record"), F.lit("OBJECT")))


def rejected(lines: DataFrame) -> DataFrame:
    """file_path and number of its lines that hold no JSON object."""
    parsed = lines.withColumn("record", F.try_parse_json("line"))
    bad = parsed.filter(~F.coalesce(F.startswith(F.schema_of_variant("record"), F.lit("OBJECT")), F.lit(False)))
    return bad.groupBy("file_path").agg(F.count("*").alias("rejected"))
