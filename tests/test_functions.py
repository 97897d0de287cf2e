"""Column expressions against plain Python, and the operators that need no logs."""

import random
import re
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from sessionlake.functions import paths as P
from sessionlake.functions import text as X
from sessionlake.functions import timeconv as C
from sessionlake.functions import tools as Tl
from sessionlake.operators import discover as D
from sessionlake.operators import registry as R
from sessionlake.operators.merge import merge_rows
from sessionlake.plans import reports
from sessionlake.sources.headers import first_line_headers, folders_frame, read_ignored, root_list, session_index, walk_folders, workspaces


def each(spark, expr, values, kind="string"):
    """expr of each value, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").select("i", expr(F.col("x")).alias("y"))
    return [r["y"] for r in df.orderBy("i").collect()]


def fuzz(n=150, seed=1):
    rng = random.Random(seed)
    pools = ["abc XYZ", "\r\n\t", "\x1b[1;31m", "\x00\x07\x7f\x1b", "é…日😀", "/", "  ", "\n\n\n"]
    return ["".join(rng.choice(rng.choice(pools)) if rng.random() < 0.9 else "\x1b[0m" for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_sanitize(spark):
    def plain(s):
        s = s.replace("\r\n", "\n").replace("\r", "\n")
        return re.sub("[\x00-\x08\x0b-\x1f\x7f]", "", re.sub("\x1b\\[[0-9;]*[a-zA-Z]", "", s))

    values = fuzz()
    assert each(spark, X.sanitize, [*values, None]) == [*map(plain, values), None]


def test_truncate_and_length(spark):
    values = [*fuzz(), "x" * 10, "x" * 11]
    assert each(spark, lambda c: X.truncate(c, 10), [*values, None]) == [v if len(v) <= 10 else v[:9] + "…" for v in values] + [""]
    assert each(spark, lambda c: X.truncate(c, 0), ["", "a", None]) == ["", "…", ""]
    assert each(spark, X.full_length, [*values, None]) == [*map(len, values), 0]


def test_prompt_and_response_form(spark):
    values = fuzz(seed=2)
    prompt = lambda s: re.sub("[ \t]+", " ", re.sub("\n{3,}", "\n\n", s)).strip()
    response = lambda s: "\n".join(x.rstrip() for x in s.splitlines() if x.strip())
    clean = [v for v in values if not re.search("[\x1c-\x1f]", v)]
    assert each(spark, X.normal_prompt, [*clean, None]) == [*map(prompt, clean), ""]
    assert each(spark, X.normal_response, [*clean, None]) == [*map(response, clean), ""]


def test_classification(spark):
    assert each(spark, X.user_subtype, ["/x", " \n\t/x", "x /", "", None]) == ["slash_command"] * 2 + ["prompt"] * 3
    assert each(spark, X.outcome, ["Timeout while", "NOT READY", "is not_ready", "Completed", "success timeout", "", None]) == ["timeout", "not_ready", "not_ready", "success", "timeout", "unknown", "unknown"]
    secret = "a sk-" + "B" * 20 + " api_key: 'abcdefghij_klmnopqrs' BEARER  abc.def-ghi_jklmnopqrst sk-short"
    assert each(spark, X.redact, [secret]) == ["a [REDACTED] [REDACTED]' [REDACTED] sk-short"]
    assert each(spark, lambda c: X.for_display(c, 5), [b"a\xffb\x07cdefg", b"ok"], "binary") == ["a�bc…", "ok"]


def test_times(spark):
    texts = ["2024-03-09T16:00:00Z", "2024-03-09T16:00:00.25+02:00", "2024-03-09 16:00", "2024-03-09", "12", "soon", ""]
    want = [datetime(2024, 3, 9, 16, tzinfo=UTC), datetime(2024, 3, 9, 14, 0, 0, 250000, tzinfo=UTC), datetime(2024, 3, 9, 16, tzinfo=UTC), datetime(2024, 3, 9, tzinfo=UTC)]
    assert each(spark, C.iso_ms, texts) == [d.timestamp() * 1000 for d in want] + [None] * 3
    rows = ['{"timestamp":5}', '{"timestamp":0,"message":{"timestamp":7}}', '{"timestamp":"","message":{"timestamp":"1970-01-01T00:00:01Z"}}', '{"timestamp":"bad","message":{"timestamp":7}}', '{"timestamp":null}', "{}", '{"timestamp":true}', '{"timestamp":"12"}', '{"timestamp":12.5}']
    assert each(spark, lambda c: C.record_ms(F.parse_json(c)), rows) == [5, 7, 1000, None, None, None, 1, None, 12.5]
    assert each(spark, lambda c: C.envelope_ms(F.parse_json(c)), ["1700000000", "1700000000000", '"2024-01-01"']) == [1.7e12, 1.7e12, None]
    assert each(spark, lambda c: C.span_weeks(F.lit(0.0), c), [0.0, 1.0, C.WEEK_MS * 1.55], "double") == [None, 0.0, 1.6]
    assert each(spark, lambda c: C.days_ago(c, 86_400_000.0 * 3), [0.0, 86_400_000.0], "double") == [None, 2.0]
    assert each(spark, lambda c: C.recent(c, 1, 86_400_000.0 * 3), [86_400_000.0 * 2, 1.0], "double") == [True, False]


def test_paths(spark):
    assert each(spark, P.path_slug, ["/a/b", "a/b", "/", "/a-b/c"]) == ["-a-b", "a-b", "", "-a-b-c"]
    assert each(spark, P.slug_path, ["-a-b", "a-b", ""]) == ["/a/b", "a/b", "."]
    assert P.path_of_slug("-w-a-b", exists=lambda p: p == "/w/a-b") == "/w/a-b" and P.path_of_slug("-w-a-b", exists=lambda p: True) == "/w/a/b"
    rel = ["OLD/x", "a/OLD/b", "OLDER", "Save1", "x/Saved", "MCP/MCPs", "MCP/MCPs2", "CodingTools/x", "fine", None]
    assert each(spark, P.is_excluded, rel) == [True, True, False, True, True, True, False, True, False, False]
    assert each(spark, P.is_aggregator, ["Claude", "Claude/x", "other", None]) == [True, False, False, False]
    assert each(spark, lambda c: P.is_below(c, "/work"), ["/work", "/work/a", "/work2"]) == [True, True, False]
    assert each(spark, lambda c: P.relative(c, "/work/"), ["/work", "/work/a/b", "/other"]) == [".", "a/b", None]
    assert each(spark, P.session_id, ["/a/b.c.jsonl", "/a/plain"]) == ["b.c", "plain"]
    assert [P.root_is_allowed(x) for x in ("", "a/../b", ".hid/x", "/home/.config", "./a", "a")] == [False, False, False, True, True, True]
    assert [P.skips_recursion(x, frozenset({"mine"})) for x in (".git", "Node_Modules", "Mine", "src")] == [True, True, True, False]


@pytest.mark.parametrize(
    ("name", "given", "want"),
    [
        ("Bash", '{"command":"ls","x":1}', '{"command":"ls"}'),
        ("bash", "{}", None),
        ("Read", '{"limit":3,"path":"p"}', '{"path":"p","limit":3}'),
        ("Grep", '{"pattern":"' + "a" * 201 + '"}', '{"pattern":"' + "a" * 199 + '…"}'),
        ("grep", '{"pattern":null}', '{"pattern":null}'),
        ("Task", '{"prompt":5,"description":"d"}', '{"description":"d","prompt":5}'),
        ("Other", '{"z": 1.0,"a":[1]}', '{"z": 1.0,"a":[1]}'),
        (None, '{"k":1}', '{"k":1}'),
    ],
)
def test_tool_input(spark, name, given, want):
    got = spark.createDataFrame([(name, given)], "n string, j string").select(Tl.tool_input(F.col("n"), F.parse_json("j"), F.col("j")).alias("y")).first()["y"]
    assert got == want


def test_leaf_and_root_paths(spark):
    paths = ["/a", "/a/b", "/a/b/c", "/ab", "/x/y", "/x/yz"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert sorted(r["path"] for r in D.leaf_paths(df).collect()) == ["/a/b/c", "/ab", "/x/y", "/x/yz"]
    assert sorted(r["path"] for r in D.root_paths(df).collect()) == ["/a", "/ab", "/x/y", "/x/yz"]
    found = spark.createDataFrame([("/w/p", "Codex"), ("/w/p", "CC"), ("/w/p/OLD/q", "CC"), ("/w/Claude", "CC"), ("/w2/z", "CC")], "path string, vendor string")
    assert [(r["path"], r["vendor"]) for r in D.canonical(found, "/w").collect()] == [("/w/p", "CC|Codex")]


def test_merge_keeps_last_rows(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, seq int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, seq int")
    once = merge_rows(old, new, ["k"], ["seq"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", 0), (2, "d", 2), (3, "e", 1)]
    assert sorted(map(tuple, merge_rows(once, new, ["k"], ["seq"]).collect())) == sorted(map(tuple, once.collect()))


def test_registry(spark, tmp_path):
    folder = str(tmp_path / "reg")
    assert R.load(spark, folder).count() == 0
    with pytest.raises(ValueError):
        R.load(spark, folder, strict=True)
    scan = spark.createDataFrame([("/p", "CC", 2, 1.5, None), ("/q", "Codex", 1, 0.1, 2.0)], "full_path string, vendor string, sess long, mb double, span_weeks double")
    R.save(R.merge_scan(R.load(spark, folder), scan, "t1"), folder)
    sources = spark.sql("SELECT '/p' AS path, map('Claude', named_struct('sessions', 1L, 'events', 2L, 'last_ingestion', 't2')) AS new_sources")
    R.save(R.merge_sources(R.load(spark, folder), sources, "t2"), folder)
    R.save(R.mark_seen(R.load(spark, folder), spark.createDataFrame([("/r",), ("",)], "path string"), "t3"), folder)
    got = {r["path"]: r.asDict(True) for r in R.load(spark, folder, strict=True).collect()}
    assert sorted(got) == ["/p", "/q", "/r"] and got["/p"]["scan"]["by_vendor"]["CC"]["sess"] == 2 and got["/p"]["sources"]["Claude"]["events"] == 2
    assert got["/r"]["walk"] == {"last_seen": "t3"} and got["/q"]["last_scan"] == "t1" and got["/q"]["last_ingestion"] is None
    shown = R.with_registry(scan.unionByName(scan.withColumn("full_path", F.lit("/new"))), R.load(spark, folder)).collect()
    assert {(r["full_path"], r["reg_updated"]) for r in shown} == {("/p", "t2"), ("/q", "t1")}
    (tmp_path / "reg" / R.FILE_NAME).write_text("{not json")
    assert R.load(spark, folder).count() == 0
    with pytest.raises(ValueError):
        R.load(spark, folder, strict=True)


def test_small_sources(spark, tmp_path):
    a = tmp_path / "a"
    (a / "x").mkdir(parents=True)
    (a / "node_modules" / "deep").mkdir(parents=True)
    (a / "x" / "skip").mkdir()
    (a / "link").symlink_to(a / "x")
    assert sorted(walk_folders([str(a), str(a)], ignored=frozenset({"skip"}))) == [str(a), str(a / "x")]
    assert list(walk_folders([str(a)], recurse=False)) == [str(a)] and str(a / "x") not in list(walk_folders([str(a)], max_depth=1))
    assert folders_frame(spark, ["/x"]).first()["path"] == "/x"
    ignore = tmp_path / "ignore"
    ignore.write_text("# c\nFoo\n\n")
    assert read_ignored(str(tmp_path / "none"), str(ignore)) == {"foo"}
    roots = tmp_path / "roots"
    roots.write_text(f"# c\n{a}\n../up\n{a}\n")
    assert root_list(str(roots), ["/tmp", ""]) == ([str(a), "/tmp"], ["../up"])
    for bad in (str(tmp_path / "none"), str(a)):
        with pytest.raises(ValueError):
            root_list(bad)
    (tmp_path / "i.json").write_text('{"entries":[{"projectPath":"/p","fileMtime":5,"messageCount":2},{"isSidechain":true}]}')
    (tmp_path / "bad.json").write_text("{")
    assert sorted((r["projectPath"] or "", r["messageCount"] or 0) for r in session_index(spark, [str(tmp_path / "i.json"), str(tmp_path / "bad.json")]).collect()) == [("", 0), ("/p", 2)]
    for i, text in enumerate(['{"folder":"file:///p"}', '{"folder":{"path":"/q"}}', '{"folder":""}', "{}", "no"]):
        (tmp_path / f"w{i}.json").write_text(text)
    assert sorted(r["folder"] for r in workspaces(spark, [str(tmp_path / f"w{i}.json") for i in range(5)]).collect()) == ["/p", "/q"]
    (tmp_path / "h1.jsonl").write_text('{"type":"session_meta","timestamp":"2024-01-01T00:00:00Z","payload":{"cwd":"/p"}}\n')
    (tmp_path / "h2.jsonl").write_text('{}\n{"type":"session_meta","payload":{"cwd":"/q"}}\n')
    assert [(r["cwd"], r["ts"]) for r in first_line_headers(spark, [str(tmp_path / "h1.jsonl"), str(tmp_path / "h2.jsonl")]).collect()] == [("/p", 1704067200000.0)]


def test_all_sessions_are_numbered_like_the_first(spark):
    rows = [(f"s{i:03}", "Claude", float(i % 7) * 4e7, None if i % 5 == 0 else float(i * 37 % 50) * 4e7, None) for i in range(60)]
    s = spark.createDataFrame(rows, "id string, source string, started_at double, ended_at double, project_path string")
    order = sorted(rows, key=lambda r: (-(r[3] if r[3] is not None else r[2]), r[0]))
    every = {r["id"]: r["num"] for r in reports.numbered_sessions(s).collect()}
    assert every == {r[0]: i for i, r in enumerate(order, 1)}
    assert {r["id"]: r["num"] for r in reports.numbered_sessions(s, 9).collect()} == {r[0]: i for i, r in enumerate(order[:9], 1)}
    assert reports.numbered_sessions(s, 0).count() == 60


def test_command_line_options():
    from sessionlake import cli

    args = cli.parser().parse_args(["query", "--tool", "--dir", "a", "--dir", "b"])
    assert args.tool == 0 and args.dir == ["a", "b"] and cli.parser().parse_args(["query", "--tool", "3"]).tool == 3
    assert cli.parser().parse_args(["query"]).tool is None
    assert [cli.env_flag({"SESSIONLAKE_X": v}, "X") for v in ("1", "TRUE", "yes", "on", "0")] == [True, True, True, False, False]
    assert cli.config_errors({"SESSIONLAKE_MESSAGE_LOGS": "/a"}) == []
    assert len(cli.config_errors({"SESSIONLAKE_DAYS": "0", "SESSIONLAKE_MIN_SIZE": "-1", "SESSIONLAKE_MESSAGE_LOGS": "rel"})) == 3
