"""Small sources of discovery: session indexes, log headers, workspace descriptors, folder walks and lists."""

from __future__ import annotations

import os
import time
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import local_path, root_is_allowed, skips_recursion, without_file_scheme
from ..functions.timeconv import envelope_ms
from ..schema import INDEX_SCHEMA
from .lines import numbered_lines, records


def session_index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """index_path and the fields of each entry of session index files; unreadable files give no rows."""
    if not paths:
        return spark.createDataFrame([], "index_path string").select("index_path", *(F.lit(None).cast(f.dataType).alias(f.name) for f in INDEX_SCHEMA["entries"].dataType.elementType.fields))
    read = spark.read.schema(INDEX_SCHEMA).json(paths, multiLine=True).select(local_path(F.col("_metadata.file_path")).alias("index_path"), F.explode("entries").alias("e"))
    return read.select("index_path", "e.*")


def first_line_headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_path, size, cwd, ts of logs whose first line is a session header."""
    first = records(numbered_lines(spark, paths).filter(F.col("line_no") == 1))
    kind = F.try_variant_get("record", "$.type", "string")
    return first.filter(kind == "session_meta").select("file_path", "size", F.try_variant_get("record", "$.payload.cwd", "string").alias("cwd"), F.coalesce(envelope_ms(F.try_variant_get("record", "$.timestamp", "variant"), read_text=True), F.lit(0.0)).alias("ts"))


def session_headers(recs: DataFrame) -> DataFrame:
    """file_path, id, cwd from the first session header on any line of a log."""
    head = recs.filter(F.try_variant_get("record", "$.type", "string") == "session_meta")
    found = F.struct(F.try_variant_get("record", "$.payload.id", "string").alias("id"), F.try_variant_get("record", "$.payload.cwd", "string").alias("cwd"))
    return head.groupBy("file_path").agg(F.min_by(found, "line_no").alias("h")).select("file_path", F.nullif("h.id", F.lit("")).alias("id"), F.nullif("h.cwd", F.lit("")).alias("cwd"))


def workspaces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """descriptor (its path) and folder of workspace descriptors, whose folder is a text or an object with a path."""
    if not paths:
        return spark.createDataFrame([], "descriptor string, folder string")
    read = spark.read.text(paths, wholetext=True).select(local_path(F.col("_metadata.file_path")).alias("descriptor"), F.try_parse_json("value").alias("v"))
    folder = F.coalesce(F.try_variant_get("v", "$.folder.path", "string"), F.when(F.schema_of_variant(F.try_variant_get("v", "$.folder", "variant")) == "STRING", F.try_variant_get("v", "$.folder", "string")))
    return read.select("descriptor", without_file_scheme(folder).alias("folder")).filter(F.col("folder") != "")


def walk_folders(roots: Iterable[str], recurse: bool = True, ignored: frozenset[str] = frozenset(), prune: frozenset[str] = frozenset(), max_depth: int = 16, max_minutes: float = 100) -> Iterator[str]:
    """Folders below the roots, each once; no links, no skipped names; pruned folders are left out with all below."""
    seen: set[str] = set()
    end = time.monotonic() + max_minutes * 60
    for root in dict.fromkeys(os.path.realpath(r) for r in roots if os.path.isdir(r)):
        if not recurse:
            if root not in seen:
                seen.add(root)
                yield root
            continue
        for folder, names, _ in os.walk(root, followlinks=False):
            if time.monotonic() > end:
                return
            depth = len(Path(folder).relative_to(root).parts)
            if depth >= max_depth or folder in prune or (depth and os.path.islink(folder)):
                names.clear()
                continue
            names[:] = [n for n in names if not skips_recursion(n, ignored) and not os.path.islink(os.path.join(folder, n))]
            if folder not in seen:
                seen.add(folder)
                yield folder


def folders_frame(spark: SparkSession, folders: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(f,) for f in folders], "path string")


def read_ignored(*candidates: str) -> frozenset[str]:
    """Names from the first ignore file that exists, one on each line, # for comments."""
    for path in candidates:
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                lines = [x.strip().lower() for x in f]
            return frozenset(x for x in lines if x and not x.startswith("#"))
    return frozenset()


def root_list(list_file: str | None, extra: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """(roots, rejected): resolved roots from a list file and from arguments, in order, each once.

    Raises ValueError where the file is missing, is no file, or names no root.
    """
    named: list[str] = []
    if list_file is not None:
        if not os.path.isfile(list_file):
            raise ValueError(f"not a readable list of folders: {list_file}")
        with open(list_file, encoding="utf-8") as f:
            named = [x for x in (line.strip() for line in f) if x and not x.startswith("#")]
        if not named:
            raise ValueError(f"no folder in the list: {list_file}")
    named += [x for x in extra if x]
    allowed = [x for x in named if root_is_allowed(x)]
    return list(dict.fromkeys(os.path.realpath(x) for x in allowed)), [x for x in named if not root_is_allowed(x)]
