"""Project discovery: candidate paths, canonical forms, and metrics for each project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timeconv as C
from ..functions.paths import is_aggregator, is_below, is_excluded, relative

# Vendors as scan results name them, in this order.
VENDORS = ["CC", "Codex", "Cursor"]


def ancestors(path: Column) -> Column:
    """All folders above a path, without the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def leaf_paths(paths: DataFrame, col: str = "path") -> DataFrame:
    """Paths that no other path lies below: each path sends its ancestors, which are then taken out by equality."""
    above = paths.select(F.explode(ancestors(F.col(col))).alias(col), F.col(col).alias("below")).filter(F.col(col) != F.col("below")).select(col).distinct()
    return paths.join(above, col, "left_anti")


def root_paths(paths: DataFrame, col: str = "path") -> DataFrame:
    """Paths that lie below no other path."""
    known = paths.select(F.col(col).alias("above")).distinct()
    up = paths.select(F.col(col), F.explode(ancestors(F.col(col))).alias("above")).filter(F.col(col) != F.col("above"))
    return paths.join(up.join(known, "above").select(col).distinct(), col, "left_anti")


def canonical(found: DataFrame, root: str) -> DataFrame:
    """Rows (path, vendor) below root whose path is no aggregator, not excluded, and a leaf; vendors joined in fixed order.

    Excluded paths don't count as children.
    """
    rel = relative(F.col("path"), root)
    kept = found.filter(is_below(F.col("path"), root) & ~is_aggregator(rel) & ~is_excluded(rel))
    by_path = kept.groupBy("path").agg(F.collect_set("vendor").alias("vendors"))
    joined = F.concat_ws("|", *(F.when(F.array_contains("vendors", v), F.lit(v)) for v in VENDORS))
    return leaf_paths(by_path).select("path", "vendors", joined.alias("vendor"))


def index_metrics(entries: DataFrame, sizes: DataFrame, days: int | None = None, now_ms: float = 0, sidechains: bool = False) -> DataFrame:
    """project, sess, events, bytes, min_ts, max_ts of index entries; sizes: file_path, size of the logs they name."""
    time = F.coalesce("fileMtime", F.lit(0.0))
    kept = entries.filter(C.recent(time, days, now_ms) & (~F.coalesce("isSidechain", F.lit(False)) | F.lit(sidechains)))
    sized = kept.join(sizes.select(F.col("file_path").alias("fullPath"), "size"), "fullPath", "left")
    return _spans(sized.select(F.col("projectPath").alias("project"), F.coalesce("messageCount", F.lit(0)).alias("events"), F.coalesce("size", F.lit(0)).alias("bytes"), F.nullif("fileMtime", F.lit(0.0)).alias("ts")))


def header_metrics(headers: DataFrame, line_counts: DataFrame, days: int | None = None, now_ms: float = 0) -> DataFrame:
    """The same of logs with a header (file_path, size, cwd, ts); line_counts: file_path, events."""
    kept = headers.filter(C.recent(F.col("ts"), days, now_ms)).join(line_counts, "file_path", "left")
    return _spans(kept.select(F.col("cwd").alias("project"), F.coalesce("events", F.lit(0)).alias("events"), F.col("size").alias("bytes"), F.nullif("ts", F.lit(0.0)).alias("ts")))


def file_metrics(files: DataFrame, days: int | None = None, now_ms: float = 0) -> DataFrame:
    """The same of bare log files (project, mtime in seconds, size), where there is no index."""
    ms = F.col("mtime") * 1000.0
    return _spans(files.filter(C.recent(ms, days, now_ms)).select("project", F.lit(0).alias("events"), F.col("size").alias("bytes"), ms.alias("ts")))


def _spans(rows: DataFrame) -> DataFrame:
    return rows.groupBy("project").agg(F.count("*").alias("sess"), F.sum("events").cast("long").alias("events"), F.sum("bytes").cast("long").alias("bytes"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))


def store_metrics(per_store: DataFrame) -> DataFrame:
    """The same of key/value stores (project, sessions, events, size): distinct within each store, then added up."""
    none = F.lit(None).cast("double")
    return per_store.groupBy("project").agg(F.sum("sessions").alias("sess"), F.sum("events").alias("events"), F.sum("size").alias("bytes")).select("*", none.alias("min_ts"), none.alias("max_ts"))


def project_metrics(projects: DataFrame, a: DataFrame, b: DataFrame, kv: DataFrame, root: str, days: int | None = None, now_ms: float = 0) -> DataFrame:
    """path (below root), dir_path, vendor, sess, mb, span_weeks of each canonical project.

    Sizes are rounded for each vendor before they are added; the span is that of
    the first vendor with one.  With days set, projects without a recent
    session go, but for those with a key/value store.
    """
    out, recent = projects, F.lit(False)
    for name, m in zip(VENDORS, (a, b, kv)):
        mine = m.select(F.col("project").alias("path"), F.col("sess").alias(f"sess_{name}"), C.megabytes(F.col("bytes")).alias(f"mb_{name}"), C.span_weeks(F.col("min_ts"), F.col("max_ts")).alias(f"span_{name}"), F.coalesce("max_ts", F.lit(0.0)).alias(f"max_{name}"))
        out = out.join(mine, "path", "left")
        has = F.array_contains("vendors", name)
        recent = recent | (has if name == VENDORS[2] else has & F.coalesce(C.recent(F.col(f"max_{name}"), days, now_ms), F.lit(not days)))
    total = lambda p: sum((F.when(F.array_contains("vendors", v), F.coalesce(f"{p}_{v}", F.lit(0))).otherwise(F.lit(0)) for v in VENDORS), F.lit(0))
    shown = F.coalesce(relative(F.col("path"), root), F.col("path"))
    span = F.coalesce(F.nullif("span_CC", F.lit(0.0)), F.col("span_Codex"))
    return out.filter(recent).select(shown.alias("path"), F.col("path").alias("dir_path"), "vendor", total("sess").cast("long").alias("sess"), total("mb").cast("double").alias("mb"), span.alias("span_weeks"))


def worthy(scan: DataFrame, least_sessions: int = 2, least_mb: float = 1.0) -> DataFrame:
    return scan.filter((F.col("sess") >= least_sessions) | (F.col("mb") >= least_mb))


def first_of_path(scans: DataFrame) -> DataFrame:
    """Of rows (full_path, root_no, ..) found under several roots, those of the first root."""
    first = scans.groupBy("full_path").agg(F.min("root_no").alias("root_no"))
    return scans.join(first, ["full_path", "root_no"])


def candidates(scan: DataFrame) -> DataFrame:
    """Scan rows with the most sessions first, then by path."""
    return scan.orderBy(F.desc("sess"), "path")


def without_sessions(repositories: DataFrame, scan: DataFrame) -> DataFrame:
    """Paths of repositories that a scan has no sessions of."""
    return repositories.select("path").distinct().join(scan.select("path"), "path", "left_anti")
