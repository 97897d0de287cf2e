"""Keyed merge, session aggregation, and the Parquet store they live in.

Plain Parquet has no MERGE.  A table is therefore cut into buckets by a hash of
its session: a merge reads and rewrites only the buckets that the new rows fall
into, keeps the last row of each key, and then commits a numbered state file
that says which folder holds which bucket.  Readers see one state or the other.
What a commit replaces is deleted by the commit after the next one, so frames
that were read just before a merge stay readable.  One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import EVENT_KEY, EVENT_SCHEMA, MANIFEST_SCHEMA, SESSION_KEY, SESSION_SCHEMA, TYPE_OF
from ..sources.commit import filesystem, publish

#: Buckets of a new table, files that one bucket's rows go to, and rows that a bucket should have at most: a table that outgrows its buckets gets more.
BUCKETS, FILES_A_BUCKET, ROWS_A_BUCKET = 64, 4, 4_000_000


def last_of_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The row of each key that comes last in the order given (columns, descending)."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") == 1).drop("__rank")


def merge_rows(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Old rows whose key is not new, and of the new rows the last of each key; whole rows are replaced."""
    latest = last_of_key(new, key, [F.desc(c) for c in order]) if order else new.dropDuplicates(key)
    return old.join(latest.select(*key), key, "left_anti").select(*latest.columns).unionByName(latest)


def sessions_of(events: DataFrame, files: DataFrame) -> DataFrame:
    """A session row for each session of emitted events.

    files: source_file, mtime (seconds), project_path, metadata.  A session
    without any timestamp is dated by its file.
    """
    spans = events.groupBy("source", "session_id").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.max("source_file").alias("source_file"))
    known = spans.join(files, "source_file", "left")
    kind = F.create_map(*[F.lit(x) for kv in TYPE_OF.items() for x in kv])
    dated = F.coalesce(F.col("mtime"), F.lit(0.0)) * 1000.0
    row = {
        "id": F.col("session_id"),
        "source": F.col("source"),
        "type": F.try_element_at(kind, F.col("source")),
        "started_at": F.coalesce("first", dated),
        "ended_at": F.coalesce("last", dated),
        "project_path": F.col("project_path"),
        "metadata": F.col("metadata"),
    }
    return known.select(*(row.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SESSION_SCHEMA.fields))


class TableVersions:
    """A Parquet table in buckets (column bucket_by; None: one bucket), with numbered states; a merge that brings too many rows doubles the buckets as often as it takes."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, bucket_by: str | None = None, buckets: int = BUCKETS, rows_a_bucket: int = ROWS_A_BUCKET):
        self.spark, self.path, self.schema, self.bucket_by, self.rows_a_bucket = spark, path, schema, bucket_by, rows_a_bucket
        state = self.state()
        self.buckets = state["of"] if state else buckets if bucket_by else 1

    def _fs(self, path: str):
        return filesystem(self.spark, path)

    def _numbers(self) -> list[int]:
        fs, at = self._fs(f"{self.path}/_state")
        if not fs.exists(at):
            return []
        names = (x.getPath().getName() for x in fs.listStatus(at))
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def state(self) -> dict | None:
        """{"n": number, "of": how many buckets, "rows": at most so many, "buckets": {bucket: folder}, "replaced": [folders]}; None before the first commit."""
        numbers = self._numbers()
        if not numbers:
            return None
        fs, at = self._fs(f"{self.path}/_state/v{numbers[-1]:08d}.json")
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, old: dict | None, folders: dict[str, str], rows: int = 0, whole: bool = False) -> None:
        """whole: the folders are all there is, else they take the place of the same buckets' folders."""
        before = old["buckets"] if old else {}
        n = old["n"] + 1 if old else 1
        kept = {} if whole else {b: f for b, f in before.items() if b not in folders}
        new = {"n": n, "of": self.buckets, "rows": rows, "buckets": kept | folders, "replaced": sorted(set(before.values()) - set(kept.values()))}
        if not publish(self.spark, at := f"{self.path}/_state/v{n:08d}.json", json.dumps(new)):
            raise OSError(f"another writer has committed {at}")
        fs, _ = self._fs(self.path)
        for folder in old["replaced"] if old else []:
            fs.delete(self._fs(f"{self.path}/{folder}")[1], True)
        for number in self._numbers()[:-2]:
            fs.delete(self._fs(f"{self.path}/_state/v{number:08d}.json")[1], False)

    def create(self) -> None:
        if self.state() is None:
            self._commit(None, {})

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        state = self.state()
        folders = [f for b, f in (state["buckets"] if state else {}).items() if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in sorted(folders)))

    def merge(self, new: DataFrame, key: list[str], order: list[str], sort_by: list[str]) -> None:
        """Upsert: of the new rows the last of each key in the order given, in place of an old row with that key."""
        rows, state = new.select(*self.schema.names), self.state()
        total = (state or {}).get("rows", 0) + rows.count()
        more = self.buckets
        while self.bucket_by and total > more * self.rows_a_bucket:
            more *= 2
        whole = more > self.buckets and bool(state and state["buckets"])
        self.buckets = more
        own = F.pmod(F.xxhash64(self.bucket_by), F.lit(self.buckets)).cast("int") if self.bucket_by else F.lit(0)
        touched = sorted(r[0] for r in rows.select(own).distinct().collect())  # as many as there are buckets, at most
        if not touched:
            return self.create()
        merged = merge_rows(self.read(None if whole else touched), rows, key, order).withColumn("__bucket", own)
        # a bucket goes to a few files, so that one long session doesn't make one long task
        dealt = merged.repartition("__bucket", F.pmod(F.xxhash64(*key), F.lit(FILES_A_BUCKET))).sortWithinPartitions("__bucket", *sort_by)
        version = f"v-{uuid.uuid4().hex}"
        dealt.write.partitionBy("__bucket").parquet(f"{self.path}/{version}")
        fs, at = self._fs(f"{self.path}/{version}")
        made = {s.getPath().getName().partition("=")[2] for s in fs.listStatus(at) if "=" in s.getPath().getName()}
        self._commit(state, {b: f"{version}/__bucket={b}" for b in sorted(made, key=int)}, total, whole)


class Store:
    """Sessions, events and the manifest of ingested sources below one folder.

    buckets: of a new store; some hundred MB of events a bucket is about right.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self._sessions = TableVersions(spark, f"{self.path}/sessions", SESSION_SCHEMA, "id", buckets)
        self._events = TableVersions(spark, f"{self.path}/events", EVENT_SCHEMA, "session_id", buckets)
        self._manifest = TableVersions(spark, f"{self.path}/manifest", MANIFEST_SCHEMA)

    def exists(self) -> bool:
        return self._sessions.state() is not None

    def create(self) -> None:
        """Empty tables where there are none yet."""
        for t in (self._sessions, self._events, self._manifest):
            t.create()

    def sessions(self) -> DataFrame:
        return self._sessions.read()

    def events(self) -> DataFrame:
        return self._events.read()

    def manifest(self) -> DataFrame:
        return self._manifest.read()

    def merge(self, events: DataFrame, sessions: DataFrame, sources: DataFrame) -> None:
        """Upsert sessions and events, then note the sources as ingested (last, so that a failed merge is tried again)."""
        self._events.merge(events, EVENT_KEY, ["line_no", "block_pos"], ["source", "session_id", "timestamp", "line_no", "block_pos"])
        self._sessions.merge(sessions, SESSION_KEY, ["ended_at"], ["source", "id"])
        self._manifest.merge(sources, ["source_key"], ["mtime"], ["source_key"])
