"""Scan: which projects have session data, and how much, from the vendors' own folders."""

from __future__ import annotations

import csv
import glob
import os
import sys
import time
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import path_of_slug
from ..operators import discover as D
from ..sources import kv
from ..sources.headers import first_line_headers, session_index, workspaces
from ..sources.lines import numbered_lines

SCAN_COLUMNS = ["path", "vendor", "sess", "mb", "span_weeks"]
REGISTRY_COLUMNS = ["reg_path", "reg_updated", "reg_sources"]


@dataclass(frozen=True)
class Places:
    """Where the vendors keep their data: folders of message logs, of envelope logs, and of workspace stores."""

    message_logs: str | None = None
    envelope_logs: str | None = None
    workspace_stores: str | None = None
    global_store: str | None = None


@dataclass(frozen=True)
class ScanOptions:
    vendors: list[str] = field(default_factory=lambda: list(D.VENDORS))
    days: int | None = None
    sidechains: bool = False
    now_ms: float | None = None


def _glob(folder: str | None, pattern: str) -> list[str]:
    return sorted(glob.glob(os.path.join(folder, pattern), recursive=True)) if folder and os.path.isdir(folder) else []


def _sizes(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    rows = [(p, os.stat(p).st_mtime, os.path.getsize(p)) for p in dict.fromkeys(paths) if p and os.path.isfile(p)]
    return spark.createDataFrame(rows, "file_path string, mtime double, size long")


def scan(spark: SparkSession, root: str, places: Places, opts: ScanOptions = ScanOptions()) -> DataFrame:
    """path, dir_path, vendor, sess, mb, span_weeks of projects below root; the global store is the path (global)."""
    root, now = os.path.realpath(root), opts.now_ms if opts.now_ms is not None else time.time() * 1000
    on = set(opts.vendors)
    found: list[tuple[str, str]] = []

    entries = session_index(spark, _glob(places.message_logs, "*/sessions-index.json") if "CC" in on else [])
    entries = entries.filter(F.col("projectPath") != "").persist()
    folders = {os.path.basename(p.rstrip("/")): p for p in _glob(places.message_logs, "*/")} if "CC" in on else {}
    found += [(path_of_slug(slug), "CC") for slug in folders]
    headers = first_line_headers(spark, _glob(places.envelope_logs, "**/*.jsonl") if "Codex" in on else []).filter(F.col("cwd") != "").persist()
    spaces = workspaces(spark, _glob(places.workspace_stores, "*/workspace.json") if "Cursor" in on else []).persist()

    candidates = (
        spark.createDataFrame(found, "path string, vendor string")
        .unionByName(entries.select(F.col("projectPath").alias("path"), F.lit("CC").alias("vendor")))
        .unionByName(headers.select(F.col("cwd").alias("path"), F.lit("Codex").alias("vendor")))
        .unionByName(spaces.select(F.col("folder").alias("path"), F.lit("Cursor").alias("vendor")))
        .distinct()
    )
    # whether a path exists is for the driver to see; there is one row for each project folder
    there = [(r["path"],) for r in candidates.select("path").distinct().collect() if os.path.isdir(r["path"])]
    projects = D.canonical(candidates.join(spark.createDataFrame(there, "path string"), "path", "left_semi"), root)

    named = [r["fullPath"] for r in entries.select("fullPath").distinct().collect()]
    a = D.index_metrics(entries, _sizes(spark, named), opts.days, now, opts.sidechains)
    # message folders without counted index entries: their logs themselves
    loose = _sizes(spark, [f for p in folders.values() for f in _glob(p, "*.jsonl")])
    by_folder = spark.createDataFrame([(p.rstrip("/"), path_of_slug(slug)) for slug, p in folders.items()], "folder string, project string")
    bare = D.file_metrics(loose.withColumn("folder", F.regexp_extract("file_path", "^(.*)/[^/]*$", 1)).join(by_folder, "folder"), opts.days, now)
    a = a.unionByName(bare.join(a.select("project"), "project", "left_anti"))
    lines = numbered_lines(spark, [r["file_path"] for r in headers.select("file_path").collect()]).groupBy("file_path").agg(F.count("*").alias("events"))
    b = D.header_metrics(headers, lines, opts.days, now)
    stores = spaces.select(F.col("folder").alias("project"), F.regexp_replace("descriptor", "workspace[.]json$", "state.vscdb").alias("db_path"))
    c = D.store_metrics(stores.join(kv.metrics(spark, [r["db_path"] for r in stores.collect()]), "db_path"))
    out = D.project_metrics(projects, a, b, c, root, opts.days, now).orderBy("dir_path")

    if "Cursor" in on and places.global_store and os.path.exists(places.global_store):
        total = kv.metrics(spark, [places.global_store]).filter((F.col("sessions") > 0) | (F.col("events") > 0))
        out = out.unionByName(total.select(F.lit("(global)").alias("path"), F.lit("").alias("dir_path"), F.lit("Cursor").alias("vendor"), F.col("sessions").alias("sess"), F.round(F.col("size") / 1048576.0, 2).alias("mb"), F.lit(None).cast("double").alias("span_weeks")))
    return out


def merge_roots(scans: list[tuple[str, DataFrame]]) -> DataFrame:
    """Scans of several roots: of a path found under two of them the first counts."""
    out = None
    for i, (root, df) in enumerate(scans):
        full = F.when(F.col("dir_path") == "", F.concat(F.lit(root + "/"), F.col("path"))).otherwise(F.col("dir_path"))
        part = df.withColumns({"full_path": full, "root_no": F.lit(i)})
        out = part if out is None else out.unionByName(part)
    return D.first_of_path(out)


def write_csv(rows: DataFrame, columns: list[str], path: str) -> int:
    """One CSV file with a header, or standard output for "-"; rows arrive one partition at a time."""
    n = 0
    if path != "-":
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    out = sys.stdout if path == "-" else open(path, "w", newline="", encoding="utf-8")
    try:
        writer = csv.writer(out)
        writer.writerow(columns)
        for r in rows.select(*columns).toLocalIterator():
            writer.writerow(["" if v is None else v for v in r])
            n += 1
    finally:
        if out is not sys.stdout:
            out.close()
    return n
