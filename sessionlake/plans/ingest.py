"""Ingest: list, prune, parse, normalise, merge - one job for each log format."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import is_below
from ..operators.merge import Store, sessions_of
from ..operators.normalize import bubble_events, envelope_events, message_events
from ..schema import EVENT_SCHEMA, MIN_SIZE
from ..sources import kv
from ..sources.headers import session_headers
from ..sources.lines import LISTING_SCHEMA, large_enough, listing, not_ingested, numbered_lines, records, rejected


@dataclass(frozen=True)
class Options:
    hide_secrets: bool = False
    keep_raw: bool = False
    force: bool = False
    min_size: int = MIN_SIZE
    block_identity: bool = False
    read_text_times: bool = False
    with_assistant: bool = False
    #: Let the first file that fails end the ingest; else the others go on without it.
    stop: bool = False


@dataclass(frozen=True)
class Summary:
    """Sources read, sessions and events in them, lines that held no JSON object, and files left out because they failed, with the reason."""

    sources: int
    sessions: int
    emitted: int
    rejected: int = 0
    failed: tuple[tuple[str, str], ...] = ()

    def __add__(self, other: Summary) -> Summary:
        return Summary(self.sources + other.sources, self.sessions + other.sessions, self.emitted + other.emitted, self.rejected + other.rejected, self.failed + other.failed)


NOTHING = Summary(0, 0, 0)


def _paths(files: DataFrame) -> list[str]:
    """Paths to read: names only, which Spark's readers take from the driver anyway."""
    return [r["file_path"] for r in files.select("file_path").orderBy("file_path").collect()]


def _load(store: Store, events: DataFrame, files: DataFrame, sources: DataFrame, n_sources: int, n_rejected: int = 0) -> Summary:
    spark = store.spark
    held = events.persist()
    try:
        counts = held.agg(F.count("*").alias("n"), F.count_distinct("source", "session_id").alias("s")).first()
        store.merge(held, sessions_of(held, files), sources)
    finally:
        held.unpersist()
    return Summary(n_sources, counts["s"], counts["n"], n_rejected)


def _new_files(spark: SparkSession, store: Store, folder: str, recursive: bool, opts: Options) -> DataFrame:
    if not os.path.isdir(folder) and "://" not in folder:
        return spark.createDataFrame([], LISTING_SCHEMA)
    return not_ingested(large_enough(listing(spark, folder, recursive), opts.min_size), store.manifest(), opts.force)


def _isolated(paths: list[str], load: Callable[[list[str]], Summary], stop: bool) -> Summary:
    """load(paths); where that fails, of either half, until only the files that fail by themselves are left out."""
    try:
        return load(paths)
    except Exception as e:
        if stop:
            raise
        if len(paths) == 1:
            return Summary(0, 0, 0, 0, ((paths[0], str(e).partition("\n")[0]),))
    half = len(paths) // 2
    return _isolated(paths[:half], load, stop) + _isolated(paths[half:], load, stop)


def ingest_messages(store: Store, folder: str, project: str, opts: Options = Options()) -> Summary:
    """Message logs at the top of a folder (content blocks)."""
    spark = store.spark
    files = _new_files(spark, store, folder, False, opts).persist()
    try:
        paths = _paths(files)
        if not paths:
            return NOTHING

        def load(paths: list[str]) -> Summary:
            own = files.filter(F.col("file_path").isin(paths)) if len(paths) < total else files
            lines = numbered_lines(spark, paths)
            events = message_events(records(lines), opts.hide_secrets, opts.keep_raw, opts.block_identity)
            about = own.select(F.col("file_path").alias("source_file"), "mtime", F.lit(project).alias("project_path"), F.lit(None).cast("string").alias("metadata"))
            bad = rejected(lines).agg(F.coalesce(F.sum("rejected"), F.lit(0))).first()[0]
            return _load(store, events, about, own.select(F.col("file_path").alias("source_key"), "mtime", "size"), len(paths), bad)

        total = len(paths)
        return _isolated(paths, load, opts.stop)
    finally:
        files.unpersist()


def ingest_envelopes(store: Store, folder: str, project: str, opts: Options = Options()) -> Summary:
    """Envelope logs anywhere below a folder whose session ran in the project or below it."""
    spark = store.spark
    files = _new_files(spark, store, folder, True, opts).persist()
    try:
        paths = _paths(files)
        if not paths:
            return NOTHING

        def load(paths: list[str]) -> Summary:
            recs = records(numbered_lines(spark, paths))
            headers = session_headers(recs).filter(is_below(F.col("cwd"), project)).persist()
            try:
                own = files.join(headers.select("file_path", "cwd"), "file_path")
                events = envelope_events(recs.join(headers.select("file_path"), "file_path", "left_semi"), headers, opts.hide_secrets, opts.keep_raw, opts.read_text_times, opts.with_assistant)
                about = own.select(F.col("file_path").alias("source_file"), "mtime", F.when(F.col("cwd") == ".", project).otherwise(F.col("cwd")).alias("project_path"), F.lit(None).cast("string").alias("metadata"))
                return _load(store, events, about, own.select(F.col("file_path").alias("source_key"), "mtime", "size"), own.count())
            finally:
                headers.unpersist()

        return _isolated(paths, load, opts.stop)
    finally:
        files.unpersist()


def ingest_stores(store: Store, databases: list[str], project: str | None, opts: Options = Options()) -> Summary:
    """Key/value stores; project None: the global store, whose sessions belong to no project."""
    spark = store.spark
    marker = "kv:" if project is not None else "kv:global:"
    found = [(os.path.realpath(p), marker + os.path.realpath(p), os.stat(p).st_mtime, os.path.getsize(p)) for p in databases if os.path.exists(p)]
    files = spark.createDataFrame(found, "source_file string, file_path string, mtime double, size long")
    new = not_ingested(files, store.manifest(), opts.force).persist()
    paths = [r["source_file"] for r in new.select("source_file").orderBy("source_file").collect()]
    if not paths:
        return NOTHING
    events = bubble_events(kv.bubbles(spark, paths), opts.hide_secrets)
    metadata = None if project is not None else '{"storage": "global"}'
    about = new.select("source_file", "mtime", F.lit(project).cast("string").alias("project_path"), F.lit(metadata).cast("string").alias("metadata"))
    return _load(store, events, about, new.select(F.col("file_path").alias("source_key"), "mtime", "size"), len(paths))


def source_counts(store: Store) -> DataFrame:
    """source, sessions, events of the whole store."""
    s = store.sessions().groupBy("source").agg(F.count("*").alias("sessions"))
    e = store.events().groupBy("source").agg(F.count("*").alias("events"))
    return s.join(e, "source", "full_outer").fillna(0)


assert {"source", "session_id", "event_id"} <= set(EVENT_SCHEMA.names)
