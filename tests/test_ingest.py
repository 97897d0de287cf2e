"""Logs of all three formats through ingest, merge, reports and the command line."""

import base64
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from sessionlake import cli
from sessionlake.operators.merge import Store, TableVersions
from sessionlake.operators.normalize import envelope_events, message_events
from sessionlake.plans import ingest as I
from sessionlake.plans import reports
from sessionlake.sources import kv
from sessionlake.sources.commit import publish
from sessionlake.sources.headers import session_headers
from sessionlake.sources.lines import numbered_lines, records, rejected


def block_text(t):
    return {"type": "text", "text": t}


def assistant(*blocks, **more):
    return {"type": "assistant", "message": {"role": "assistant", "content": list(blocks), **more}}


def user(*blocks):
    return {"type": "user", "message": {"content": list(blocks)}}


def call(i, name, **given):
    return {"type": "tool_use", "id": i, "name": name, "input": given}


def result(i, content, **more):
    return {"type": "tool_result", "tool_use_id": i, "content": content, **more}


MESSAGES = [
    user(block_text("please\r\nbuild \x1b[1mit\x1b[0m")),
    assistant(block_text("d" * 250), call("c1", "Bash", command="make", timeout=5), block_text("after"), timestamp=1710000000123.0),
    user(result("c1", [block_text("one"), {"type": "image"}, block_text("two")])),
    {"type": "progress", "data": 1},
    user(result("c1", "no", is_error=True)),
    assistant(block_text("r" * 2001), stop_reason="max_tokens"),
    user(block_text("  /clear")),
    assistant(call("c2", "Read", path="main.py", junk=1)),
    user(result("c9", "unpaired")),
    assistant(call("c3", "mystery", **{"b": 1.0, "a": [1, 2]})),
    assistant({"type": "thinking", "text": "x"}, call("c4", "Agent", prompt="p" * 2005, description="look")),
    {"type": "assistant", "message": {"content": "plain"}},
    {"type": "assistant", "message": None},
    {**assistant(block_text("when")), "timestamp": "2024-03-09T16:00:00.5Z"},
]


def write_lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows).encode())
    return str(path)


def stored(df):
    return {r["event_id"]: r for r in df.collect()}


@pytest.fixture
def messages(spark, tmp_path):
    path = write_lines(tmp_path / "logs" / "s1.jsonl", [*MESSAGES, "", "{bad", "[1]"])
    return records(numbered_lines(spark, [path]))


def test_message_events(messages):
    got = {(r["line_no"], r["block_pos"]): r for r in message_events(messages).collect()}
    assert got[1, 0]["content"] == "please\nbuild it" and got[1, 0]["subtype"] == "prompt" and got[1, 0]["role"] == "user"
    assert got[2, 0]["subtype"] == "dialog" and got[2, 0]["content"] == "d" * 199 + "…" and got[2, 0]["content_len"] == 250
    assert got[2, 1]["event_type"] == "tool_call" and got[2, 1]["tool_input"] == '{"command":"make"}' and got[2, 1]["content"] is None
    assert got[2, 2]["subtype"] == "response" and got[2, 2]["timestamp"] == 1710000000123.0
    assert got[3, 0]["content"] == "one\ntwo" and got[3, 0]["tool_name"] == "Bash" and got[3, 0]["tool_output"] == "one\ntwo"
    assert got[5, 0]["subtype"] == "permission_denied"
    assert got[6, 0]["subtype"] == "truncated" and len(got[6, 0]["content"]) == 2000 and got[6, 0]["content_len"] == 2001
    assert got[7, 0]["subtype"] == "slash_command"
    assert json.loads(got[8, 0]["tool_input"]) == {"path": "main.py"} and got[8, 0]["file_path"] == "main.py"
    assert got[9, 0]["tool_name"] is None and got[9, 0]["subtype"] == "tool_result"
    assert got[10, 0]["tool_input"].replace(" ", "") == '{"b":1.0,"a":[1,2]}'
    agent = json.loads(got[11, 1]["tool_input"])
    assert len(agent["prompt"]) == 2000 and agent["prompt"].endswith("…") and agent["description"] == "look"
    assert got[14, 0]["timestamp"] == 1710000000500.0
    assert not any(k[0] in (4, 12, 13) for k in got) and {r["session_id"] for r in got.values()} == {"s1"}


def test_rejected_lines(spark, messages, tmp_path):
    path = str(tmp_path / "logs" / "s1.jsonl")
    assert [r["rejected"] for r in rejected(numbered_lines(spark, [path])).collect()] == [2]


def test_lines_keep_their_numbers(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_bytes(b'{"a":1}\r\n\r{"b":"\xff"}\n\n{"c":3}')
    got = [(r["line_no"], r["line"]) for r in numbered_lines(spark, [str(path)]).orderBy("line_no").collect()]
    assert got == [(1, '{"a":1}'), (3, '{"b":"�"}'), (5, '{"c":3}')]


def test_envelope_events(spark, tmp_path):
    rows = [
        {"type": "session_meta", "payload": {"id": "sess-9", "cwd": "/p"}},
        {"type": "response_item", "timestamp": 1700000001, "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "/go"}, {"type": "other", "text": "on"}, {"type": "x"}]}},
        {"type": "response_item", "timestamp": 1700000002000, "payload": {"type": "message", "role": "developer", "content": [{"type": "output_text", "text": "ok"}]}},
        {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"text": "dropped"}]}},
        {"type": "response_item", "payload": {"type": "reasoning"}},
        {"type": "event_msg", "payload": {"type": "token_count", "info": 1}},
        {"type": "event_msg", "timestamp": "2024-01-01T00:00:00Z", "payload": {"type": "turn_aborted", "info": {"why": "x"}}},
        {"type": "event_msg", "payload": {"type": "note"}},
    ]
    recs = records(numbered_lines(spark, [write_lines(tmp_path / "b.jsonl", rows)]))
    got = stored(envelope_events(recs, session_headers(recs)))
    assert sorted(got) == ["2", "3", "7", "8"] and {r["session_id"] for r in got.values()} == {"sess-9"}
    assert got["2"]["content"] == "/go\non" and got["2"]["subtype"] == "slash_command" and got["2"]["timestamp"] == 1700000001000.0
    assert got["3"]["subtype"] == "response" and got["3"]["role"] == "assistant" and got["3"]["timestamp"] == 1700000002000.0
    assert json.loads(got["7"]["content"]) == {"why": "x"} and json.loads(got["7"]["metadata"]) == {"event_msg_type": "turn_aborted"} and got["7"]["timestamp"] is None
    assert json.loads(got["8"]["content"]) == {"type": "note"}
    again = stored(envelope_events(recs, session_headers(recs), read_text_times=True, with_assistant=True))
    assert again["7"]["timestamp"] == 1704067200000.0 and again["4"]["content"] == "dropped"


def make_kv(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE cursorDiskKV (key TEXT PRIMARY KEY, value TEXT)")
        db.executemany("INSERT INTO cursorDiskKV VALUES (?, ?)", rows)
    return str(path)


KV_ROWS = [
    ("bubbleId:c1:b2", json.dumps({"type": 2, "text": " ", "timingInfo": {"clientStartTime": 2000.0}, "toolResults": [{"toolName": "grep", "result": "hit"}, {"result": {"n": 1}}, {}]})),
    ("bubbleId:c1:b1", base64.b64encode(json.dumps({"type": 1, "text": "hello", "timingInfo": {"clientStartTime": 1000}}).encode()).decode()),
    ("bubbleId:c2:b1", json.dumps({"type": 1, "text": "/x"})),
    ("bubbleId:c2:b2", None),
    ("bubbleId:c2:b3", "nonsense"),
    ("bubbleId:c2:b4", json.dumps({"type": 7, "text": "?"})),
    ("bubbleId:short", "{}"),
    ("composerData:c1", json.dumps({"conversation": [1], "folder": "/p", "z": 1})),
    ("composerData:c2", None),
    ("composerData:c3", "%%"),
    ("other", "{}"),
]


def test_kv_source(spark, tmp_path):
    db = make_kv(tmp_path / "state.vscdb", KV_ROWS)
    assert sorted((r["composer_id"], r["bubble_id"]) for r in kv.bubbles(spark, [db]).collect()) == [("c1", "b1"), ("c1", "b2"), ("c2", "b1"), ("c2", "b4")]
    m = kv.metrics(spark, [db, str(tmp_path / "none")]).orderBy("size").collect()
    assert [(r["sessions"], r["events"]) for r in m] == [(0, 0), (2, 6)]
    c = {r["composer_id"]: r for r in kv.composers(spark, [db]).collect()}
    assert c["c1"]["top_keys"] == ["conversation", "folder", "z"] and c["c1"]["has_conversation"] and c["c1"]["folder"] == "/p"
    assert c["c2"]["value_null"] and c["c3"]["decode_error"]
    assert kv.composers(spark, [str(tmp_path / "none")]).count() == 0


def test_ingest_of_all_sources(spark, tmp_path, capsys):
    project = tmp_path / "work" / "proj"
    project.mkdir(parents=True)
    env = {"SESSIONLAKE_MESSAGE_LOGS": str(tmp_path / "a"), "SESSIONLAKE_ENVELOPE_LOGS": str(tmp_path / "b"), "SESSIONLAKE_KV_DATA": str(tmp_path / "kv"), "SESSIONLAKE_REGISTRY": str(tmp_path / "reg"), "SESSIONLAKE_MIN_SIZE": "0"}
    slug = str(project).replace("/", "-")
    write_lines(tmp_path / "a" / slug / "s1.jsonl", MESSAGES)
    write_lines(tmp_path / "b" / "2024" / "x.jsonl", [{"type": "session_meta", "timestamp": 1700000000, "payload": {"id": "e1", "cwd": str(project / "sub")}}, {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "hi"}]}}])
    write_lines(tmp_path / "b" / "2024" / "other.jsonl", [{"type": "session_meta", "payload": {"id": "e2", "cwd": "/elsewhere"}}])
    make_kv(tmp_path / "kv" / "workspaceStorage" / "w1" / "state.vscdb", KV_ROWS)
    (tmp_path / "kv" / "workspaceStorage" / "w1" / "workspace.json").write_text(json.dumps({"folder": {"path": f"file://{project}"}}))

    def run(*args):
        return cli.main([*args, "--dir", str(project)], env, spark), capsys.readouterr().out

    assert run("query", "--stats")[0] == 1  # nothing is there yet
    code, out = run("ingest")
    assert code == 0
    store = Store(spark, str(project / cli.STORE_DIR))
    # of several blocks of a record the last one is stored
    kept = stored(store.events().filter("source = 'Claude'"))
    assert kept["2"]["content"] == "after" and kept["11"]["tool_name"] == "Agent" and len(kept) == 11
    s = {r["id"]: r for r in store.sessions().collect()}
    assert sorted(s) == ["c1", "c2", "e1", "s1"] and s["c1"]["type"] == "IDE" and (s["c1"]["started_at"], s["c1"]["ended_at"]) == (1000.0, 2000.0)
    assert s["e1"]["project_path"] == str(project / "sub") and s["s1"]["started_at"] == 1710000000123.0
    kv_rows = stored(store.events().filter("source = 'Cursor'"))
    assert kv_rows["c1:b2"]["subtype"] == "dialog" and kv_rows["c1:b2:tr0"]["tool_name"] == "grep" and json.loads(kv_rows["c1:b2:tr1"]["content"]) == {"n": 1}
    assert kv_rows["c1:b2:tr2"]["tool_name"] == "unknown" and kv_rows["c1:b2:tr2"]["content"] == ""

    before = (sorted(map(str, store.events().collect())), sorted(map(str, store.sessions().collect())))
    assert "Ingested: 0 sessions" in run("ingest")[1]  # nothing new
    run("ingest", "--force")
    assert (sorted(map(str, store.events().collect())), sorted(map(str, store.sessions().collect()))) == before

    code, out = run("query", "--stats")
    assert code == 0 and "Sessions: 4" in out
    assert "Bash" not in run("query", "--tool")[1] and "Read" in run("query", "--tool")[1]
    # sessions without times are dated by their files, so they are the most recent
    assert [x.split("\t")[:2] for x in run("query", "--sessions", "--id")[1].splitlines()[3:]] == [["s1", "3"], ["c1", "4"]]
    code, out = run("query", "--sess", "3")
    assert "## User" in out and "[agent] Agent" in out and "[permission_denied] Bash" in out and "## Model" in out
    assert run("query", "--sess", "9")[0] == 1 and run("query")[0] == 1
    assert "s1" in run("query", "--permissions")[1] and "Tool counts" in run("query", "--task-review")[1] and "slash_command" in run("query", "--taxonomy")[1]
    reg = json.loads((tmp_path / "reg" / "ingested_projects.json").read_text())["projects"][0]
    assert reg["query"] == {"sessions": 4, "events": store.events().count()} and set(reg["sources"]) == {"Claude", "Codex", "Cursor"}

    # the folder's name is ambiguous here (hyphens), so the index names the project; a side chain doesn't count
    log = {"projectPath": str(project), "sessionId": "s1", "fileMtime": 1.7e12, "messageCount": 14, "isSidechain": False, "fullPath": str(tmp_path / "a" / slug / "s1.jsonl")}
    (tmp_path / "a" / slug / "sessions-index.json").write_text(json.dumps({"entries": [log, {**log, "isSidechain": True}]}))
    code, _ = cli.main(["scan", "--dir", str(tmp_path / "work"), "--out", str(tmp_path / "scan.csv"), "--days", "0"], env, spark), capsys.readouterr()
    assert code == 0
    rows = (tmp_path / "scan.csv").read_text().splitlines()
    assert rows[0] == "path,vendor,sess,mb,span_weeks" and rows[1].startswith("proj,CC|Cursor,3,")
    assert cli.main(["scan", "--dir", str(tmp_path / "work"), "--source", "nope"], env, spark) == 1
    assert cli.main([], env, spark) == 2


def test_block_identity_keeps_all_blocks(spark, messages):
    ids = [r["event_id"] for r in message_events(messages, block_identity=True).collect()]
    assert len(ids) == len(set(ids)) and "2:1" in ids


def test_raw_bytes(messages):
    raw = [r["source_raw"] for r in message_events(messages, keep_raw=True).select("source_raw").collect()]
    assert all(1 <= len(x) <= 512 for x in raw)


def test_secrets_are_hidden_before_truncation(spark, tmp_path):
    recs = records(numbered_lines(spark, [write_lines(tmp_path / "r.jsonl", [user(block_text("key sk-" + "a" * 30))])]))
    r = message_events(recs, hide_secrets=True).first()
    assert r["content"] == "key [REDACTED]" and r["content_len"] == 14


def test_kv_sources_are_isolated(spark, tmp_path):
    store = Store(spark, str(tmp_path / "st"))
    store.create()
    bad = tmp_path / "bad.vscdb"
    bad.write_text("not a database")
    assert I.ingest_stores(store, [str(bad)], "/p", I.Options()).emitted == 0
    good = make_kv(tmp_path / "g.vscdb", KV_ROWS)
    assert I.ingest_stores(store, [good], None, I.Options()).sessions == 2
    assert {r["metadata"] for r in store.sessions().collect()} == {'{"storage": "global"}'}
    assert reports.tool_histogram(store.sessions(), store.events()).count() == 0
    assert store.sessions().filter(F.col("project_path").isNotNull()).count() == 0


def test_only_failing_files_are_left_out():
    def load(paths):
        if "bad" in paths or "worse" in paths:
            raise ValueError(f"{len(paths)} files\nmore")
        return I.Summary(len(paths), 1, 2)

    got = I._isolated(["a", "bad", "b", "c", "worse"], load, False)
    assert got.sources == 3 and dict(got.failed) == {"bad": "1 files", "worse": "1 files"}
    with pytest.raises(ValueError):
        I._isolated(["a", "bad"], load, True)


def test_a_version_is_made_once(spark, tmp_path):
    at = str(tmp_path / "v1.json")
    assert publish(spark, at, "first") and not publish(spark, at, "second")
    assert open(at).read() == "first" and not [p for p in tmp_path.iterdir() if p.name.endswith(".tmp")]


def test_a_table_gets_more_buckets(spark, tmp_path):
    schema = "id string, n long"
    t = TableVersions(spark, str(tmp_path / "t"), spark.createDataFrame([], schema).schema, "id", buckets=2, rows_a_bucket=10)
    rows = [(f"k{i}", i) for i in range(18)]
    t.merge(spark.createDataFrame(rows, schema), ["id"], ["n"], ["id"])
    assert t.buckets == 2
    more = [(f"k{i}", 100 + i) for i in range(12, 60)]
    t.merge(spark.createDataFrame(more, schema), ["id"], ["n"], ["id"])
    again = TableVersions(spark, str(tmp_path / "t"), t.schema, "id")
    assert again.buckets == 8 and {tuple(r) for r in again.read().collect()} == {*rows[:12], *more}
    again.merge(spark.createDataFrame([("k1", 7)], schema), ["id"], ["n"], ["id"])
    assert again.read().count() == 60 and again.read().filter("id = 'k1'").first()["n"] == 7


def test_roots_that_are_not_allowed_are_named(capsys, tmp_path):
    with pytest.raises(SystemExit):
        cli.main(["--version"])
    assert "sessionlake" in capsys.readouterr().out
    assert cli.main(["query", "--dir", "../x", "--stats"], {}) == 1
    assert "../x" in capsys.readouterr().err
