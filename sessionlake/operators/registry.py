"""The project registry: one row for each path, merged block by block.

On disk it is the JSON document {"projects": [..], "updated": ..}; as a
DataFrame it has REGISTRY_SCHEMA.  A merge only touches the block it brings.
"""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import REGISTRY_SCHEMA

FILE_NAME = "ingested_projects.json"


def now_iso() -> str:
    return datetime.now(UTC).isoformat()


def load(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """Rows of the registry; a missing or unreadable file gives none, or ValueError with strict."""
    path = os.path.join(folder, FILE_NAME)
    if not os.path.exists(path):
        if strict:
            raise ValueError(f"no registry: {path}")
        return spark.createDataFrame([], REGISTRY_SCHEMA)
    if strict:
        try:
            with open(path, encoding="utf-8") as f:
                json.load(f)
        except ValueError as e:
            raise ValueError(f"unreadable registry: {path}") from e
    doc = spark.read.schema(T.StructType([T.StructField("projects", T.ArrayType(REGISTRY_SCHEMA))])).json(path, multiLine=True)
    return doc.select(F.explode("projects").alias("p")).select("p.*").filter(F.col("path") != "").dropDuplicates(["path"])


def save(registry: DataFrame, folder: str, now: str | None = None) -> None:
    """Write the document beside its place and move it there. A registry has a row for each project, so it fits the driver."""
    os.makedirs(folder, exist_ok=True)
    projects = [_without_nulls(json.loads(line)) for line in registry.orderBy("path").toJSON().collect()]
    beside = os.path.join(folder, f".{FILE_NAME}.{os.getpid()}")
    with open(beside, "w", encoding="utf-8") as f:
        json.dump({"projects": projects, "updated": now or now_iso()}, f, indent=2)
    os.replace(beside, os.path.join(folder, FILE_NAME))


def _without_nulls(x):
    return {k: _without_nulls(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else x


def _joined(registry: DataFrame, block: DataFrame, **changed) -> DataFrame:
    """Full outer join by path; columns in `changed` take the expressions given, the others stay."""
    b = block.withColumnRenamed("path", "__path")
    both = registry.join(b, registry["path"] == b["__path"], "full_outer")
    return both.select(F.coalesce("path", "__path").alias("path"), *(changed.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in REGISTRY_SCHEMA.fields[1:]))


def merge_sources(registry: DataFrame, ingested: DataFrame, now: str) -> DataFrame:
    """ingested: path, new_sources (map by vendor); vendors that come replace their entry."""
    new = F.col("new_sources").isNotNull()
    merged = F.when(new, F.map_concat(F.coalesce("sources", F.create_map().cast(REGISTRY_SCHEMA["sources"].dataType)), "new_sources")).otherwise(F.col("sources"))
    return _joined(registry, ingested, sources=merged, last_ingestion=F.when(new, F.lit(now)).otherwise(F.col("last_ingestion")))


def merge_scan(registry: DataFrame, scanned: DataFrame, now: str) -> DataFrame:
    """scanned: full_path, vendor, sess, mb, span_weeks; a path's scan block is replaced."""
    entry = F.struct("vendor", F.struct(F.col("sess").cast("long").alias("sess"), F.col("mb").cast("double").alias("mb"), F.col("span_weeks").cast("double").alias("span_weeks")).alias("m"))
    block = scanned.dropDuplicates(["full_path", "vendor"]).groupBy(F.col("full_path").alias("path")).agg(F.map_from_entries(F.collect_list(entry)).alias("by_vendor_new"))
    new = F.col("by_vendor_new").isNotNull()
    return _joined(registry, block, scan=F.when(new, F.struct(F.col("by_vendor_new").alias("by_vendor"))).otherwise(F.col("scan")), last_scan=F.when(new, F.lit(now)).otherwise(F.col("last_scan")))


def merge_query(registry: DataFrame, counts: DataFrame, now: str) -> DataFrame:
    """counts: path, n_sessions, n_events."""
    new = F.col("n_sessions").isNotNull()
    return _joined(registry, counts, query=F.when(new, F.struct(F.col("n_sessions").alias("sessions"), F.col("n_events").alias("events"))).otherwise(F.col("query")), last_query=F.when(new, F.lit(now)).otherwise(F.col("last_query")))


def mark_seen(registry: DataFrame, paths: DataFrame, now: str) -> DataFrame:
    """paths: path; sets when a walk last saw them."""
    seen = paths.filter(F.col("path") != "").select("path").distinct().withColumn("seen", F.lit(True))
    return _joined(registry, seen, walk=F.when(F.col("seen"), F.struct(F.lit(now).alias("last_seen"))).otherwise(F.col("walk")))


def shown_time() -> F.Column:
    """The first time there is: ingestion, scan, query."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in ("last_ingestion", "last_scan", "last_query")), F.lit(""))


def with_registry(scan: DataFrame, registry: DataFrame) -> DataFrame:
    """Scan rows (full_path, ..) whose path the registry knows, with reg_path, reg_updated, reg_sources."""
    known = registry.select(F.col("path").alias("full_path"), F.col("path").alias("reg_path"), shown_time().alias("reg_updated"), F.coalesce(F.to_json("sources"), F.lit("{}")).alias("reg_sources"))
    return scan.join(known, "full_path")
