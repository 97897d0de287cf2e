"""A sharded store with size-tiered compaction and versioned manifests.

Arrivals are appended as runs of small, immutable Parquet shards.  Runs are
tiered by size: as soon as a tier has `fanout` runs, they are merged into one
run of files near the target size.  Whatever changes, a new manifest
version is committed: it is written beside its place and renamed into it, so a
reader sees a version as a whole or not at all, and a version that another
writer has taken is not overwritten (where renaming would overwrite, as in
local folders, a link is made instead, which fails if the name is there).  An
append that loses such a race is committed again after the version that won; a
compaction gives up its run.  Files are deleted only by `vacuum`, when no
version that is kept names them; a job that fails leaves the last version as it
was, and vacuum finds the run that it left.

Defined results: rows and all columns (nulls, long texts, repeats) come back as
they were, whatever the columns are called; an arrival without rows adds no
run; an empty store reads as no rows of the given schema.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.commit import publish
from .common import discard, filesystem, fresh, scratch

TARGET_BYTES = 64 << 20
FANOUT = 4
#: Bytes from which tiers are counted.
TIER_UNIT = 1 << 20


@dataclass(frozen=True)
class Run:
    path: str
    rows: int
    bytes: int
    files: int

    def tier(self, fanout: int) -> int:
        return max(0, int(math.log(max(1, self.bytes / TIER_UNIT), fanout)))


class VersionTaken(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.path, self.schema = spark, path, schema
        self.target_bytes, self.fanout = target_bytes, fanout

    # manifests

    def versions(self) -> list[int]:
        fs, at = filesystem(self.spark, f"{self.path}/manifest")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Run]]:
        """Version (0: nothing committed yet) and its runs."""
        known = self.versions()
        version = version if version is not None else (known[-1] if known else 0)
        if not version:
            return 0, []
        fs, at = filesystem(self.spark, f"{self.path}/manifest/v{version:08d}.json")
        stream = fs.open(at)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return version, [Run(**r) for r in json.loads(text)["runs"]]

    def commit(self, version: int, runs: list[Run]) -> int:
        """Make `runs` the version after `version`."""
        at = f"{self.path}/manifest/v{version + 1:08d}.json"
        if not publish(self.spark, at, json.dumps({"version": version + 1, "runs": [asdict(r) for r in runs]}, indent=1)):
            raise VersionTaken(at)
        return version + 1

    def _add(self, run: Run, tries: int = 20) -> int:
        """Commit the present runs and `run`, after whatever others commit meanwhile."""
        for left in reversed(range(tries)):
            version, runs = self.manifest()
            try:
                return self.commit(version, [*runs, run])
            except VersionTaken:
                if not left:
                    raise
        raise AssertionError

    # writing

    def _measured(self, path: str) -> Run | None:
        fs, at = filesystem(self.spark, path)
        sizes = [s.getLen() for s in fs.listStatus(at) if s.getPath().getName().endswith(".parquet")]
        rows = self.spark.read.schema(self.schema).parquet(path).count() if sizes else 0
        if not rows:
            discard(self.spark, path)
            return None
        return Run(path, rows, sum(sizes), len(sizes))

    def append(self, df: DataFrame) -> int:
        """Add an arrival as a run of its own; the version that has it."""
        path = f"{self.path}/runs/{uuid.uuid4().hex}"
        df.select(*self._columns()).write.parquet(path)
        run = self._measured(path)
        return self._add(run) if run else self.manifest()[0]

    def append_all(self, df: DataFrame, arrival) -> int:
        """Add many arrivals, told apart by the integer column `arrival`, in one pass over df; a version for each."""
        path = f"{self.path}/runs/{uuid.uuid4().hex}"
        name = fresh(self.schema.names, "arrival")
        df.select(*self._columns(), arrival.cast("int").alias(name)).write.partitionBy(name).parquet(path)
        fs, at = filesystem(self.spark, path)
        found = sorted((s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith(f"{name}=")), key=lambda p: int(p.getName().partition("=")[2]))
        for p in found:
            if run := self._measured(p.toString()):
                self._add(run)
        return self.manifest()[0]

    def compact(self) -> int:
        """Merge tiers that are full, from the smallest on, until none is; the last version."""
        while True:
            version, runs = self.manifest()
            tiers: dict[int, list[Run]] = {}
            for r in runs:
                tiers.setdefault(r.tier(self.fanout), []).append(r)
            full = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout), None)
            if full is None:
                return version
            files = max(1, round(sum(r.bytes for r in full) / self.target_bytes))
            path = f"{self.path}/runs/{uuid.uuid4().hex}"
            # whole input partitions are put together into each file: no shuffle
            self.spark.read.schema(self.schema).parquet(*(r.path for r in full)).coalesce(files).write.parquet(path)
            try:
                self.commit(version, [*(r for r in runs if r not in full), self._measured(path)])
            except VersionTaken:
                discard(self.spark, path)
                raise

    def vacuum(self, keep_versions: int = 1, orphans_after: float = 7 * 86400) -> int:
        """Delete runs that none of the last versions names, and older manifests; how many runs went.

        Runs that no version names at all may be another writer's, not yet
        committed; they go when they are orphans_after seconds old.
        """
        known = self.versions()
        kept = {r.path for v in known[-keep_versions:] for r in self.manifest(v)[1]}
        gone = {r.path for v in known[:-keep_versions] for r in self.manifest(v)[1]} - kept
        for path in gone:
            discard(self.spark, path)
        for v in known[:-keep_versions]:
            discard(self.spark, f"{self.path}/manifest/v{v:08d}.json")
        fs, at = filesystem(self.spark, f"{self.path}/runs")
        named = {part for path in kept for part in path.split("/")}
        orphans = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName() not in named and s.getModificationTime() / 1000 <= time.time() - orphans_after] if fs.exists(at) else []
        for p in orphans:
            # folders of arrivals whose runs have all been merged are empty by now
            gone |= {p.toString()} if fs.getContentSummary(p).getFileCount() else set()
            fs.delete(p, True)
        return len(gone)

    # reading

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version."""
        _, runs = self.manifest(version)
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(r.path for r in runs))

    def _columns(self) -> list[Column]:
        return [F.col(f"`{n.replace('`', '``')}`") for n in self.schema.names]


def report(docs: DataFrame, arrivals: int = 8) -> DataFrame:
    """Store docs as `arrivals` arrivals, compact, and read the store back.

    doc_id, text_hash (xxhash64 of the stored text), stored_chars, shard (file) of every row; version, runs and shards of the store.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, scratch(spark, "shards"), docs.schema)
    store.append_all(docs, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)))
    version = store.compact()
    store.vacuum()
    _, runs = store.manifest()
    rows = store.read()
    return rows.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("stored_chars"),
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("shard"),
        F.lit(version).cast("long").alias("version"),
        F.lit(len(runs)).cast("long").alias("runs"),
        F.lit(sum(r.files for r in runs)).cast("long").alias("shards"),
    )
