"""Command line: scan, ingest and query. Options come from flags, then from SESSIONLAKE_* variables."""

from __future__ import annotations

import argparse
import os
import subprocess
import sys
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions.paths import path_slug
from .operators import registry as R
from .operators.merge import Store
from .plans import ingest as I
from .plans import reports
from .plans import scan as S
from .schema import CONF, MIN_SIZE, RECENT_DAYS, TAXONOMY
from .sources.headers import root_list

STORE_DIR = ".sessionlake"
VENDOR_OF = {"cc": "CC", "codex": "Codex", "cursor": "Cursor"}
YES = ("1", "true", "yes")
#: Sessions that a tool table has columns for.
WIDEST = 200


def env_flag(env: Mapping[str, str], name: str) -> bool:
    return env.get(f"SESSIONLAKE_{name}", "0").lower() in YES


def env_int(env: Mapping[str, str], name: str, default: int) -> int:
    return int(env.get(f"SESSIONLAKE_{name}", default))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sessionlake", description="Session records: scan finds projects, ingest loads logs, query reports.")
    p.add_argument("command", nargs="?", choices=("scan", "ingest", "query"))
    p.add_argument("-v", "--verbose", action="store_true", help="ingest: a line for each source")
    p.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    p.add_argument("--dirs", help="file with one root on each line")
    p.add_argument("--dir", action="append", default=[], help="a root; may be given again")
    p.add_argument("--source", default="all", help="scan: cc,codex,cursor; ingest: one of them, or all")
    p.add_argument("--out", default="scan.csv", help="scan: CSV file, - for standard output")
    p.add_argument("--registry", help="folder of the registry; scan then lists known projects only")
    for flag in ("stop", "norec", "debug", "subagent", "redact", "force", "stats", "taxonomy", "sessions", "id", "permissions", "task-review"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--days", type=int)
    p.add_argument("--min-size", type=int)
    p.add_argument("--tool", type=int, nargs="?", const=0, help="tool table of the N most recent sessions; bare: all")
    p.add_argument("-sess", "--sess", type=int)
    p.add_argument("--show", default="", help="comma list of prompt, pr, agent, tool, perm")
    return p


def places(env: Mapping[str, str]) -> S.Places:
    """Where the vendors keep their logs, by variables or in the usual folders."""
    home = os.path.expanduser("~")
    kv = env.get("SESSIONLAKE_KV_DATA", os.path.join(home, ".config", "Cursor", "User"))
    return S.Places(
        env.get("SESSIONLAKE_MESSAGE_LOGS", os.path.join(home, ".claude", "projects")),
        env.get("SESSIONLAKE_ENVELOPE_LOGS", os.path.join(home, ".codex", "sessions")),
        os.path.join(kv, "workspaceStorage"),
        os.path.join(kv, "globalStorage", "state.vscdb"),
    )


def config_errors(env: Mapping[str, str]) -> list[str]:
    days, size = env_int(env, "DAYS", RECENT_DAYS), env_int(env, "MIN_SIZE", MIN_SIZE)
    found = [] if 1 <= days <= 3650 else [f"days {days} is not within 1..3650"]
    found += [] if size >= 0 else [f"smallest size {size} is below 0"]
    return found + ([] if os.path.isabs(places(env).message_logs or "/") else ["the folder of message logs must be absolute"])


def git_root(folder: str) -> str:
    try:
        got = subprocess.run(["git", "-C", folder, "rev-parse", "--show-toplevel"], capture_output=True, text=True, timeout=5)
    except (OSError, subprocess.TimeoutExpired):
        return folder
    return got.stdout.strip() if got.returncode == 0 and got.stdout.strip() else folder


def roots(args: argparse.Namespace) -> list[str]:
    found, rejected = root_list(args.dirs, args.dir)
    for r in rejected:
        print(f"skipped, not allowed as a root: {r}", file=sys.stderr)
    if rejected and not found:
        raise ValueError("no root is left")
    return found or [os.getcwd() if args.command == "scan" else git_root(os.getcwd())]


def registry_dir(args: argparse.Namespace, env: Mapping[str, str]) -> str:
    return args.registry or env.get("SESSIONLAKE_REGISTRY") or os.path.join(os.path.expanduser("~"), STORE_DIR)


def session(env: Mapping[str, str]) -> SparkSession:
    builder = SparkSession.builder.appName("sessionlake")
    if not env.get("SPARK_REMOTE") and not env.get("MASTER"):
        builder = builder.master(env.get("SESSIONLAKE_MASTER", "local[*]"))
    for k, v in CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k, v in CONF.items():
        spark.conf.set(k, v)
    return spark


def print_rows(df: DataFrame, header: bool = True) -> int:
    """Tab-separated rows, one partition at a time; nothing at all where there are none."""
    n = 0
    for row in df.toLocalIterator():
        if header and not n:
            print("\t".join(df.columns))
        print("\t".join("" if x is None else str(x) for x in row))
        n += 1
    return n


def run_scan(spark: SparkSession, args: argparse.Namespace, env: Mapping[str, str]) -> int:
    wanted = list(VENDOR_OF) if args.source == "all" else [x.strip() for x in args.source.split(",") if x.strip()]
    if bad := [x for x in wanted if x not in VENDOR_OF]:
        print(f"unknown source: {', '.join(bad)}", file=sys.stderr)
        return 1
    if errors := config_errors(env):
        print("\n".join(errors), file=sys.stderr)
        return 1
    days = None if args.debug else args.days if args.days is not None else env_int(env, "DAYS", RECENT_DAYS)
    opts = S.ScanOptions([VENDOR_OF[x] for x in wanted], days, args.subagent or env_flag(env, "SUBAGENT"))
    rows = S.merge_roots([(r, S.scan(spark, r, places(env), opts)) for r in args.roots]).persist()
    folder = registry_dir(args, env)
    shown, columns = rows, S.SCAN_COLUMNS if not args.debug else ["path", "dir_path", *S.SCAN_COLUMNS[1:]]
    try:
        known = R.load(spark, folder, strict=bool(args.registry))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    if args.registry:
        shown, columns = R.with_registry(rows, known), [*columns, *S.REGISTRY_COLUMNS]
    shown = shown.orderBy("full_path").persist()
    shown.count()  # before the registry changes
    R.save(R.merge_scan(known, rows, R.now_iso()), folder)
    S.write_csv(shown, columns, args.out)
    return 0


def _folder_of(spark: SparkSession, project: str) -> str:
    """Name of a project's folder of message logs."""
    return spark.range(1).select(path_slug(F.lit(project))).first()[0]


def run_ingest(spark: SparkSession, args: argparse.Namespace, env: Mapping[str, str]) -> int:
    if args.source not in (*VENDOR_OF, "all"):
        print(f"unknown source: {args.source}", file=sys.stderr)
        return 1
    at, on = places(env), list(VENDOR_OF) if args.source == "all" else [args.source]
    opts = I.Options(
        hide_secrets=args.redact or env_flag(env, "REDACT"),
        keep_raw=args.debug or env_flag(env, "DEBUG"),
        force=args.force or env_flag(env, "FORCE"),
        min_size=args.min_size if args.min_size is not None else env_int(env, "MIN_SIZE", MIN_SIZE),
        block_identity=env_flag(env, "BLOCK_IDENTITY"),
        read_text_times=env_flag(env, "READ_TEXT_TIMES"),
        with_assistant=env_flag(env, "WITH_ASSISTANT"),
        stop=args.stop or env_flag(env, "STOP"),
    )
    failed, total = 0, I.NOTHING
    for project in args.roots:
        store = Store(spark, os.path.join(project, STORE_DIR))
        store.create()
        messages = os.path.join(at.message_logs or "", _folder_of(spark, project))
        if args.source == "cc" and not os.path.isdir(messages):
            print(f"no message logs of {project}", file=sys.stderr)
            return 1
        databases = [r["db"] for r in _workspace_stores(spark, at, project)]
        steps = {
            "cc": [lambda: I.ingest_messages(store, messages, project, opts)],
            "codex": [lambda: I.ingest_envelopes(store, at.envelope_logs or "", project, opts)],
            "cursor": [lambda: I.ingest_stores(store, databases, project, opts), lambda: I.ingest_stores(store, [at.global_store] if at.global_store else [], None, opts)],
        }
        for name, step in ((name, s) for name in on for s in steps[name]):
            try:
                done = step()
                total = total + done
                if args.verbose:
                    print(f"{project}: {name}: {done.sources} sources, {done.sessions} sessions, {done.emitted} events")
                for path, why in done.failed:
                    print(f"{path}: {why}", file=sys.stderr)
                failed += len(done.failed)
            except Exception as e:
                if opts.stop:
                    raise
                print(f"{project}: {e}", file=sys.stderr)
                failed += 1
        counts = I.source_counts(store).withColumn("last_ingestion", F.lit(R.now_iso()))
        entry = F.map_from_entries(F.collect_list(F.struct("source", F.struct("sessions", "events", "last_ingestion"))))
        block = counts.agg(entry.alias("new_sources")).select(F.lit(project).alias("path"), "new_sources")
        folder = registry_dir(args, env)
        R.save(R.merge_sources(R.load(spark, folder), block, R.now_iso()), folder)
        done = counts.agg(F.coalesce(F.sum("sessions"), F.lit(0)), F.coalesce(F.sum("events"), F.lit(0))).first()
        print(f"Ingested: {total.sessions} sessions, {total.emitted} events, {total.rejected} lines rejected")
        print(f"Store: {done[0]} sessions, {done[1]} events")
    return 1 if failed else 0


def _workspace_stores(spark: SparkSession, at: S.Places, project: str) -> list:
    from .functions.paths import is_below
    from .sources.headers import workspaces

    found = workspaces(spark, S._glob(at.workspace_stores, "*/workspace.json")).filter(is_below(F.col("folder"), project))
    return found.select(F.regexp_replace("descriptor", "workspace[.]json$", "state.vscdb").alias("db")).collect()


def run_query(spark: SparkSession, args: argparse.Namespace, env: Mapping[str, str]) -> int:
    project = args.roots[0]
    store = Store(spark, os.path.join(project, STORE_DIR))
    if not store.exists():
        print(f"no store below {project}", file=sys.stderr)
        return 1
    sessions, events = store.sessions(), store.events()
    if args.stats:
        n = reports.stats(sessions, events).first()
        print(f"Sessions: {n['sessions']}\nEvents: {n['events']}")
        folder = registry_dir(args, env)
        block = spark.createDataFrame([(project, n["sessions"], n["events"])], "path string, n_sessions long, n_events long")
        R.save(R.merge_query(R.load(spark, folder), block, R.now_iso()), folder)
    elif args.taxonomy:
        for kind, subs in TAXONOMY.items():
            print("\n".join([kind, *(f"  {s}" for s in subs)]))
    elif args.tool is not None:
        n = min(args.tool, sessions.count()) if args.tool > 0 else sessions.count()
        if n > WIDEST:  # a line for each tool and session instead of a column for each session
            print_rows(reports.tool_histogram(sessions, events, args.tool or None).drop("is_standard"))
        elif n:
            rows = reports.tool_table(sessions, events, n).collect()  # a row for each tool
            width = max((len(r["tool_name"]) for r in rows), default=10)
            print("  ".join(["", "Sess", *map(str, range(1, n + 1)), "Total"]))
            for r in rows:
                print("  ".join([r["tool_name"].ljust(width), *(str(x) for x in r[1:])]))
    elif args.sessions:
        rows = reports.session_list(sessions)
        print_rows(rows if args.id else rows.drop("num"))
    elif args.sess is not None:
        if args.sess < 1 or not reports.numbered_sessions(sessions, args.sess).filter(F.col("num") == args.sess).count():
            print(f"No session {args.sess}", file=sys.stderr)
            return 1
        parts = tuple(x for x in args.show.replace(",", " ").split() if x) or reports.ALL_PARTS
        for r in reports.transcript(reports.session_by_number(sessions, events, args.sess), parts).toLocalIterator():
            print(r["rendered"])
    elif args.permissions:
        print_rows(reports.permissions(events))
    elif args.task_review:
        titles = {"tools": "Tool counts", "task": "Task tools", "web": "Web* tools", "invocations": "Task/Agent invocations", "outcomes": "Task result outcomes"}
        for name, df in reports.task_review(events).items():
            if name in ("invocations", "outcomes") and df.isEmpty():
                continue
            print(f"=== {titles[name]} ===")
            print_rows(df, header=False)
    else:
        print("nothing asked for", file=sys.stderr)
        return 1
    return 0


def main(argv: list[str] | None = None, env: Mapping[str, str] | None = None, spark: SparkSession | None = None) -> int:
    args, env = parser().parse_args(argv), env if env is not None else os.environ
    if not args.command:
        parser().print_usage(sys.stderr)
        return 2
    try:
        args.roots = roots(args)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return {"scan": run_scan, "ingest": run_ingest, "query": run_query}[args.command](spark or session(env), args, env)


if __name__ == "__main__":
    sys.exit(main())
