"""Project paths: slugs, exclusions and prefixes, as Columns and for the driver's own lists."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders that discovery leaves out.
AGGREGATORS = ["Claude", "Claw", "CodingTools", "Cursor", "Github", "WP", "ZK"]
REVIEW_DIRS = ["Claude/Claudes", "Claw/Claws", "CodingTools", "MCP/MCPs", "Spank/sOSS", "ZK/ZKs"]
NO_RECURSE = ["__pycache__", "bin", "build", "debug", "doc", "docs", "env", "lib", "libs", "log", "logs", "node_modules", "old", "release", "save", "test", "tests", "var", "venv"]


def path_slug(path: Column) -> Column:
    """/a/b to -a-b, a/b to a-b, / to the empty text."""
    bare = F.regexp_replace(path, "^/+", "")
    return F.when(F.startswith(path, F.lit("/")), F.when(bare == "", F.lit("")).otherwise(F.concat(F.lit("-"), F.translate(bare, "/", "-")))).otherwise(F.translate(path, "/", "-"))


def slug_path(slug: Column) -> Column:
    """The path a slug stands for, if no folder name has a hyphen."""
    return F.when(slug == "", F.lit(".")).when(F.startswith(slug, F.lit("-")), F.concat(F.lit("/"), F.translate(F.substring(slug, 2, 1 << 20), "-", "/"))).otherwise(F.translate(slug, "-", "/"))


def path_of_slug(slug: str, exists=os.path.exists) -> str:
    """What a slug may stand for, the first that exists: each hyphen a folder boundary, or the last one a hyphen; else the former."""
    plain = slug.replace("-", "/") or "."
    above, _, last = plain.rpartition("/")
    candidates = [plain, f"{above}-{last}"] if "/" in above else [plain]
    return next(filter(exists, candidates), plain)


def relative(path: Column, root: str) -> Column:
    """The path below root; null outside of it."""
    base = root.rstrip("/")
    return F.when(path == (base or "/"), F.lit(".")).when(F.startswith(path, F.lit(base + "/")), F.substring(path, len(base) + 2, 1 << 20))


def is_below(path: Column, root: str | Column) -> Column:
    """The root itself or a path under it, at a folder boundary."""
    base = F.lit(root.rstrip("/")) if isinstance(root, str) else root
    return (path == base) | F.startswith(path, F.concat(base, F.lit("/")))


def is_excluded(rel: Column, review_dirs: list[str] | None = None) -> Column:
    """Backup and review folders, by the path below the root; false outside of it."""
    tests = [F.contains(rel, F.lit("/OLD/")), F.startswith(rel, F.lit("OLD/")), F.contains(rel, F.lit("/Save")), F.startswith(rel, F.lit("Save"))]
    tests += [is_below(rel, d) for d in (REVIEW_DIRS if review_dirs is None else review_dirs)]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def is_aggregator(rel: Column, names: list[str] | None = None) -> Column:
    return F.coalesce(~F.contains(rel, F.lit("/")) & rel.isin(AGGREGATORS if names is None else names), F.lit(False))


def session_id(file_path: Column) -> Column:
    """A log file's name without its extension."""
    return F.regexp_replace(F.regexp_extract(file_path, "([^/]+)$", 1), r"(?<=.)\.[^.]+$", "")


def without_file_scheme(path: Column) -> Column:
    return F.regexp_replace(path, "^file://", "")


def local_path(uri: Column) -> Column:
    """A file:/ URI as a path; others as they are."""
    return F.when(F.startswith(uri, F.lit("file:")), F.url_decode(F.replace(F.regexp_replace(uri, "^file:/+", "/"), F.lit("+"), F.lit("%2B")))).otherwise(uri)


def skips_recursion(name: str, ignored: frozenset[str] = frozenset()) -> bool:
    low = name.lower()
    return name.startswith(".") or low in NO_RECURSE or low in ignored


def root_is_allowed(raw: str) -> bool:
    """False for empty roots, roots with .., and relative roots with a hidden folder."""
    text = raw.strip()
    names = [x for x in text.split("/") if x]
    if not text or ".." in names:
        return False
    return text.startswith("/") or not any(x.startswith(".") and x != "." for x in names)
