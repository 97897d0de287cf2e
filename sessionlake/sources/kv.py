"""Key/value rows of SQLite stores as a Spark data source, decoded into variants.

Each database is one input partition, opened read-only in the task.  The
prefix is matched by SQLite itself (its LIKE ignores ASCII case), and values
are left unread where only keys are asked for.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KV_SCHEMA = "db_path string, mtime double, size long, pos long, key string, value string"


class _Database(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _KvReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["paths"].split("\n") if p]
        self.prefix = options["prefix"]
        self.keys_only = options.get("keysonly", options.get("keysOnly", "false")) == "true"

    def partitions(self) -> list[InputPartition]:
        return [_Database(p) for p in self.paths] or [_Database("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = partition.path
        if not path or not os.path.exists(path):
            return
        about = os.stat(path)
        try:
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                db.text_factory = lambda b: b.decode("utf-8", "replace")
                value = "NULL" if self.keys_only else "CAST(value AS TEXT)"
                for pos, (key, text) in enumerate(db.execute(f"SELECT key, {value} FROM cursorDiskKV WHERE key LIKE ? || ':%'", (self.prefix,))):
                    yield path, about.st_mtime, about.st_size, pos, key, text
        except sqlite3.Error:
            return


class KvSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_kv"

    def schema(self) -> str:
        return KV_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _KvReader(self.options)


def rows(spark: SparkSession, paths: list[str], prefix: str, keys_only: bool = False) -> DataFrame:
    """KV_SCHEMA rows whose key starts with the prefix; databases that are missing or unreadable give none."""
    spark.dataSource.register(KvSource)
    return spark.read.format("sqlite_kv").option("paths", "\n".join(paths)).option("prefix", prefix).option("keysOnly", str(keys_only).lower()).load()


def _decoded(df: DataFrame) -> DataFrame:
    """Adds text (the value, or what its base64 holds) and data (variant)."""
    plain = F.try_parse_json("value")
    inner = F.make_valid_utf8(F.try_to_binary("value", F.lit("base64")).cast("string"))
    text = F.when(plain.isNotNull(), F.col("value")).otherwise(inner)
    return df.withColumn("text", text).withColumn("data", F.try_parse_json("text"))


def bubbles(spark: SparkSession, paths: list[str]) -> DataFrame:
    """db_path, mtime, pos, composer_id, bubble_id, text, data of messages whose value is an object."""
    parts = F.split("key", ":")
    named = rows(spark, paths, "bubbleId").filter(F.col("value").isNotNull() & (F.size(parts) >= 3))
    got = _decoded(named).filter(F.startswith(F.schema_of_variant("data"), F.lit("OBJECT")))
    return got.select("db_path", "mtime", "pos", parts[1].alias("composer_id"), parts[2].alias("bubble_id"), "text", "data")


def composers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """What is known of each composer: keys of its value, whether it has a conversation, and the project fields."""
    df = _decoded(rows(spark, paths, "composerData"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant("data"), F.lit("OBJECT")), F.lit(False))
    field = lambda k: F.when(is_object, F.get_json_object("text", f"$.{k}")).alias(k)
    return df.select(
        "db_path",
        F.regexp_extract("key", "^[^:]*:(.*)$", 1).alias("composer_id"),
        "key",
        F.col("value").isNull().alias("value_null"),
        (F.col("value").isNotNull() & F.col("data").isNull()).alias("decode_error"),
        F.when(is_object, F.json_object_keys("text")).alias("top_keys"),
        F.coalesce(F.json_array_length(F.get_json_object("text", "$.conversation")) > 0, F.lit(False)).alias("has_conversation"),
        *(field(k) for k in ("workspaceRoot", "workspace", "folder", "projectPath")),
    )


def metrics(spark: SparkSession, paths: list[str]) -> DataFrame:
    """db_path, sessions (distinct composers), events (messages, with null values too), size; from keys alone."""
    parts = F.split("key", ":")
    got = rows(spark, paths, "bubbleId", keys_only=True).filter(F.size(parts) >= 3)
    counted = got.groupBy("db_path").agg(F.countDistinct(parts[1]).alias("sessions"), F.count("*").alias("events"))
    sizes = spark.createDataFrame([(p, os.path.getsize(p) if os.path.exists(p) else 0) for p in paths], "db_path string, size long")
    return sizes.join(counted, "db_path", "left").fillna(0, ["sessions", "events"])
