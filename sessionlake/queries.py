"""The engine's operators as queries over the driver's tables, each with the SQL that gives the same rows.

Views: the events table stands for tool calls (a user is a session, an event
type a tool), conversations for messages, pages for project paths, and
documents for text of all kinds.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import sqlite3
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import paths as P
from .functions import text as X
from .functions import timeconv as C
from .functions import tools as Tl
from .operators import discover as D
from .operators import registry as R
from .operators import normalize as N
from .operators.merge import Store, last_of_key, merge_rows, sessions_of
from .plans import reports
from .plans.ingest import source_counts
from .plans.scan import write_csv
from .schema import EVENT_KEY, REGISTRY_SCHEMA
from .sources import headers as H
from .sources import kv as K
from .sources import lines as L

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# views


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as tool calls; errors are denials."""
    e = table(spark, sf_dir, "events")
    error = F.col("event_type") == "error"
    return e.select(
        F.lit("Claude").alias("source"),
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_id").cast("string").alias("event_id"),
        F.when(error, "user_message").otherwise("tool_call").alias("event_type"),
        F.when(error, "permission_denied").alias("subtype"),
        F.col("event_type").alias("tool_name"),
        F.col("props").alias("tool_input"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000.0)).alias("timestamp"),
        F.col("event_id").alias("line_no"),
        F.lit(0).alias("block_pos"),
    )


def call_sessions(events: DataFrame) -> DataFrame:
    """Sessions of calls(), which come from no file."""
    files = events.sparkSession.createDataFrame([], "source_file string, mtime double, project_path string, metadata string")
    return sessions_of(events.withColumn("source_file", F.lit(None).cast("string")), files)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own in spark.checkpoint.dir; where that is unset, one that goes with this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="sessionlake-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return f"{found}/{name}-{uuid.uuid4().hex}"


# conversations as logs of the three formats


def _members(**fields) -> F.Column:
    """JSON text of an object; fields that are null are left out."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))


def _records(spark: SparkSession, sf_dir: str, file: str, line_no, line) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.concat(F.lit(f"/logs/{file}"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("file_path"), F.lit(5.0).alias("mtime"), F.lit(1).cast("long").alias("size"), line_no.cast("long").alias("line_no"), line.alias("line"))
    return rows


def message_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of message logs: a file for each conversation, a line for each turn.

    Users' records hold the result of the call in the turn before and a text;
    the assistants' a text, but for every fourth turn a call, and sometimes a
    text after it; the system's are of a type that is skipped.
    """
    turn, text = F.col("turn"), F.col("text")
    block = "array<struct<type:string,text:string,id:string,name:string,input:struct<path:string,offset:int,junk:int,prompt:string>,tool_use_id:string,content:array<struct<type:string,text:string>>,is_error:boolean>>"
    said = lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"))

    def of(**fields) -> F.Column:
        names = ["type", "text", "id", "name", "input", "tool_use_id", "content", "is_error"]
        return F.struct(*(fields.get(n, F.lit(None)).alias(n) for n in names))

    result = of(type=F.lit("tool_result"), tool_use_id=F.concat(F.lit("c"), (turn - 1).cast("string")), content=F.array(said(F.lit("did")), said(F.concat(text, text))), is_error=turn % 4 == 0)
    spoken = of(type=F.lit("text"), text=F.when((F.col("role") == "user") & (turn % 3 == 0), F.concat(F.lit("  /"), text)).when(F.col("role") == "user", text).otherwise(F.concat(text, text)))
    given = F.struct(F.when(turn % 2 == 0, F.concat(F.lit("/p"), F.col("conv_id").cast("string"))).alias("path"), F.when(turn % 2 == 0, turn).alias("offset"), turn.alias("junk"), F.when(turn % 2 == 1, F.concat(F.lit("look "), turn.cast("string"))).alias("prompt"))
    call = of(type=F.lit("tool_use"), id=F.concat(F.lit("c"), turn.cast("string")), name=F.when(turn % 2 == 0, "Read").otherwise("Task"), input=given)
    null = F.lit(None)
    user = F.array_compact(F.array(F.when(turn > 0, result.cast(block[6:-1])).otherwise(null), spoken.cast(block[6:-1])))
    model = F.array_compact(F.array(spoken.cast(block[6:-1]), F.when(turn % 4 != 3, call.cast(block[6:-1])).otherwise(null), F.when(turn % 4 == 1, spoken.cast(block[6:-1])).otherwise(null)))
    message = F.struct(F.when(turn % 2 == 1, F.col("role")).alias("role"), F.when(F.length("text") > 300, "max_tokens").otherwise("end_turn").alias("stop_reason"), F.when(F.col("role") == "user", user).otherwise(model).alias("content"))
    ms = F.lit(1_700_000_000_000) + F.col("conv_id") * 1_000_000 + turn * 1000
    time = F.when(turn % 5 == 4, F.lit("null")).when(turn % 2 == 0, ms.cast("string")).otherwise(F.concat(F.lit('"'), F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit('"')))
    rest = _members(type=F.when(F.col("role") == "system", "progress").otherwise(F.col("role")), message=message)
    return L.records(_records(spark, sf_dir, "s", turn + 1, F.concat(F.lit('{"timestamp":'), time, F.lit(","), F.substr(rest, F.lit(2)))))


_BLOCKS = """
talk AS (
  SELECT *, turn + 1 AS line_no, 's' || conv_id AS session_id, CASE WHEN turn % 5 < 4 THEN CAST(1700000000000 + conv_id * 1000000 + turn * 1000 AS DOUBLE) END AS ts,
    CASE WHEN role = 'user' THEN CASE WHEN turn % 3 = 0 THEN '  /' || text ELSE text END ELSE text || text END AS said FROM conversations WHERE role IN ('user', 'assistant')),
blocks AS (
  SELECT *, 0 AS pos, 'tool_result' AS block_type, false AS tool_follows FROM talk WHERE role = 'user' AND turn > 0
  UNION ALL SELECT *, CASE WHEN turn > 0 THEN 1 ELSE 0 END, 'text', false FROM talk WHERE role = 'user'
  UNION ALL SELECT *, 0, 'text', turn % 4 <> 3 FROM talk WHERE role = 'assistant'
  UNION ALL SELECT *, 1, 'tool_use', false FROM talk WHERE role = 'assistant' AND turn % 4 <> 3
  UNION ALL SELECT *, 2, 'text', false FROM talk WHERE role = 'assistant' AND turn % 4 = 1),
called AS (SELECT conv_id, turn AS call_turn, CASE WHEN turn % 2 = 0 THEN 'Read' ELSE 'Task' END AS call_name FROM blocks WHERE block_type = 'tool_use'),
answered AS (
  SELECT b.*, c.call_name, CASE WHEN block_type = 'tool_result' THEN 'did' || chr(10) || text || text ELSE said END AS full_text
  FROM blocks b LEFT JOIN called c ON block_type = 'tool_result' AND b.conv_id = c.conv_id AND call_turn = turn - 1),
cut AS (
  SELECT *, CASE WHEN role = 'user' AND block_type = 'text' THEN full_text
    WHEN tool_follows THEN CASE WHEN length(full_text) > 200 THEN substring(full_text, 1, 199) || '…' ELSE full_text END
    WHEN length(full_text) > 2000 THEN substring(full_text, 1, 1999) || '…' ELSE full_text END AS shown FROM answered),
message_events AS (
  SELECT session_id, CAST(line_no AS VARCHAR) AS event_id, line_no, pos AS block_pos,
    CASE WHEN block_type = 'tool_use' THEN 'tool_call' WHEN role = 'user' THEN 'user_message' ELSE 'assistant_message' END AS event_type,
    CASE WHEN block_type = 'tool_use' THEN NULL WHEN block_type = 'tool_result' THEN CASE WHEN turn % 4 = 0 THEN 'permission_denied' ELSE 'tool_result' END
      WHEN role = 'user' THEN CASE WHEN turn % 3 = 0 THEN 'slash_command' ELSE 'prompt' END
      WHEN tool_follows THEN 'dialog' WHEN length(text) > 300 THEN 'truncated' ELSE 'response' END AS subtype,
    role, CASE WHEN block_type <> 'tool_use' THEN shown END AS content, CASE WHEN block_type <> 'tool_use' THEN length(full_text) END AS content_len,
    CASE WHEN block_type = 'tool_use' THEN CASE WHEN turn % 2 = 0 THEN 'Read' ELSE 'Task' END ELSE call_name END AS tool_name,
    CASE WHEN block_type = 'tool_use' THEN CASE WHEN turn % 2 = 0 THEN '{"path":"/p' || conv_id || '","offset":' || turn || '}' ELSE '{"prompt":"look ' || turn || '"}' END END AS tool_input,
    CASE WHEN block_type = 'tool_result' THEN shown END AS tool_output, ts AS timestamp,
    CASE WHEN block_type = 'tool_use' AND turn % 2 = 0 THEN '/p' || conv_id END AS file_path, '/logs/s' || conv_id || '.jsonl' AS source_file
  FROM cut)"""


def envelope_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of envelope logs: each conversation's file starts with a header, without an id in every seventh."""
    c = table(spark, sf_dir, "conversations")
    turn, conv = F.col("turn"), F.col("conv_id")
    header = _members(type=F.lit("session_meta"), payload=F.struct(F.when(conv % 7 > 0, F.concat(F.lit("sess-"), conv.cast("string"))).alias("id"), F.concat(F.lit("/w/p"), (conv % 5).cast("string")).alias("cwd")))
    item = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    said = F.struct(F.lit("message").alias("type"), F.when(F.col("role") == "user", "user").when(turn % 4 == 3, "assistant").otherwise("developer").alias("role"), F.array(item("input_text", F.col("text")), item("other", F.lit("more"))).alias("content"))
    note = F.struct(F.lit("turn_aborted").alias("type"), F.struct(F.concat(F.lit("x"), conv.cast("string")).alias("why")).alias("info"))
    seconds = F.lit(1_700_000_000) + turn
    time = F.when(turn % 2 == 0, seconds).otherwise(seconds * 1000).cast("long")
    line = F.when(F.col("role") == "system", _members(type=F.lit("event_msg"), timestamp=time, payload=note)).otherwise(_members(type=F.lit("response_item"), timestamp=time, payload=said))
    heads = c.select("conv_id").distinct().select(F.lit(1).alias("line_no"), header.alias("line"), "conv_id")
    rows = heads.unionByName(c.select((turn + 2).alias("line_no"), line.alias("line"), "conv_id"))
    return L.records(rows.select(F.concat(F.lit("/logs/e"), conv.cast("string"), F.lit(".jsonl")).alias("file_path"), F.lit(5.0).alias("mtime"), F.lit(1).cast("long").alias("size"), F.col("line_no").cast("long").alias("line_no"), "line"))


def bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a key/value store; clocks run backwards, and the first turn has none."""
    turn = F.col("turn")
    results = F.array(F.struct(F.lit("Read").alias("toolName"), F.col("text").alias("result")), F.struct(F.lit(None).cast("string").alias("toolName"), F.lit("z").alias("result")))
    data = _members(
        type=F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3),
        text=F.when(turn % 4 == 3, " ").otherwise(F.col("text")),
        timingInfo=F.struct(F.when(turn > 0, F.lit(1.7e12) - turn * 1000).alias("clientStartTime")),
        toolResults=F.when(F.col("role") == "assistant", results),
    )
    c = table(spark, sf_dir, "conversations")
    return c.select(F.lit("/kv").alias("db_path"), turn.cast("long").alias("pos"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("composer_id"), F.concat(F.lit("b"), turn.cast("string")).alias("bubble_id"), F.parse_json(data).alias("data"))


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct /host/path of pages."""
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", "/"), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select(F.regexp_replace(bare, "/+$", "").alias("path")).distinct()


_CALLS = """
calls AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(event_id AS VARCHAR) AS event_id, event_type AS tool_name, props AS tool_input,
    CASE WHEN event_type = 'error' THEN 'user_message' ELSE 'tool_call' END AS event_type,
    CASE WHEN event_type = 'error' THEN 'permission_denied' END AS subtype,
    epoch_us(ts) / 1000.0 AS timestamp, event_id AS line_no
  FROM events),
sessions AS (
  SELECT session_id AS id, min(timestamp) AS started_at, max(timestamp) AS ended_at,
    row_number() OVER (ORDER BY max(timestamp) DESC, session_id) AS num
  FROM calls GROUP BY session_id)"""
_PATHS = """
paths AS (
  SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '[?#].*$', ''), '/+$', '') AS path FROM pages)"""


# reports


def in_order(df: DataFrame) -> DataFrame:
    """Adds place: the number of each row in the order in which df gives its rows."""
    rows = df.withColumn("at", F.monotonically_increasing_id())  # goes up along the partitions of an ordered frame
    return rows.withColumn("place", F.row_number().over(Window.orderBy("at")).cast("long")).drop("at")  # for reports that a person reads


@query(f"""WITH {_CALLS},
c AS (SELECT tool_name, num AS sess_no, count(*) AS cnt FROM calls JOIN sessions ON id = session_id WHERE num <= 20 AND event_type = 'tool_call' GROUP BY ALL)
SELECT tool_name, sess_no, cnt, CAST(sum(cnt) OVER (PARTITION BY tool_name) AS BIGINT) AS total, false AS is_standard FROM c""")
def tool_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = calls(spark, sf_dir)
    return reports.tool_histogram(call_sessions(e), e, 20)


@query(f"""WITH {_CALLS}
SELECT tool_name, {", ".join(f"count(*) FILTER (num = {i}) AS s{i}" for i in range(1, 6))}, count(*) AS total
FROM calls JOIN sessions ON id = session_id WHERE num <= 5 AND event_type = 'tool_call' GROUP BY tool_name""")
def tool_histogram_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = calls(spark, sf_dir)
    return reports.tool_table(call_sessions(e), e, 5)


@query(f"WITH {_CALLS}, c AS (SELECT tool_name, count(*) AS cnt FROM calls WHERE event_type = 'tool_call' GROUP BY tool_name) SELECT *, row_number() OVER (ORDER BY cnt DESC, tool_name) AS place FROM c")
def tool_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_order(reports.tool_counts(calls(spark, sf_dir)))


@query(f"WITH {_CALLS} SELECT id, num, 'Claude' AS source, started_at, ended_at, '' AS project_path FROM sessions")
def sessions_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.session_list(call_sessions(calls(spark, sf_dir)))


@query(f"WITH {_CALLS} SELECT event_id, tool_name, timestamp FROM calls WHERE session_id = (SELECT id FROM sessions WHERE num = 1)")
def session_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = calls(spark, sf_dir)
    return reports.session_by_number(call_sessions(e), e, 1).select("event_id", "tool_name", "timestamp")


@query(f"""WITH {_CALLS}, shown AS (
  SELECT event_type, subtype, tool_name, CASE WHEN event_type = 'tool_call' THEN '[tool] ' || tool_name || chr(10) || '  ' || substring(tool_input, 1, 120) || chr(10)
    ELSE '[permission_denied] ' || tool_name || chr(10) END AS rendered
    , row_number() OVER (ORDER BY timestamp NULLS FIRST, line_no) AS place
  FROM calls WHERE session_id = (SELECT id FROM sessions WHERE num = 2)) SELECT * FROM shown""")
def session_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = calls(spark, sf_dir).withColumn("content", F.lit(None).cast("string"))
    return in_order(reports.transcript(reports.session_by_number(call_sessions(e), e, 2)))


@query("SELECT (SELECT count(DISTINCT user_id) FROM events) AS sessions, (SELECT count(*) FROM events) AS events")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = calls(spark, sf_dir)
    return reports.stats(call_sessions(e), e)


@query("""SELECT * FROM (VALUES (0, 'tool_call', NULL), (1, 'user_message', NULL), (2, 'user_message', 'prompt'), (3, 'user_message', 'slash_command'), (4, 'user_message', 'tool_result'), (5, 'user_message', 'permission_denied'),
  (6, 'assistant_message', NULL), (7, 'assistant_message', 'response'), (8, 'assistant_message', 'dialog'), (9, 'assistant_message', 'truncated')) t(pos, event_type, subtype)""")
def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.taxonomy(spark)


@query(f"WITH {_CALLS} SELECT session_id, timestamp, tool_name, row_number() OVER (ORDER BY timestamp NULLS FIRST, session_id) AS place FROM calls WHERE subtype = 'permission_denied'")
def permissions_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_order(reports.permissions(calls(spark, sf_dir)))


_TOOL_ALIAS = "CASE user_id % 5 WHEN 0 THEN 'Task' || event_type WHEN 1 THEN 'mcp_task' WHEN 2 THEN 'mytasks' WHEN 3 THEN 'WebFetch' ELSE event_type END"


def _aliased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls with names of every kind."""
    return table(spark, sf_dir, "events").select(F.expr(_TOOL_ALIAS).alias("tool_name"), F.lit("tool_call").alias("event_type"))


@query(f"""WITH t AS (SELECT {_TOOL_ALIAS} AS tool_name FROM events)
SELECT tool_name, count(*) AS cnt, contains(tool_name, 'Task') OR tool_name = 'mcp_task' AS task, tool_name ILIKE '%task%' AS task_like, contains(lower(tool_name), 'web') AS web,
  contains(tool_name, 'Task') OR tool_name IN ('mcp_task', 'Agent') AS agent FROM t GROUP BY tool_name""")
def tool_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = reports.tool_counts(_aliased(spark, sf_dir))
    n = F.col("tool_name")
    return c.select("tool_name", "cnt", Tl.is_task_name(n).alias("task"), Tl.is_task_like(n).alias("task_like"), Tl.is_web(n).alias("web"), Tl.is_agent(n).alias("agent"))


_OUTCOMES = [("caps", ["!!"]), ("table", [" | "]), ("secret", ["token", "password"])]


@query("""SELECT CASE WHEN contains(lower(text), '!!') THEN 'caps' WHEN contains(lower(text), ' | ') THEN 'table'
  WHEN contains(lower(text), 'token') OR contains(lower(text), 'password') THEN 'secret' ELSE 'unknown' END AS outcome, count(*) AS cnt FROM documents GROUP BY 1""")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(X.outcome(F.col("text"), _OUTCOMES).alias("outcome")).agg(F.count("*").alias("cnt"))


# messages


@query(f"WITH {_BLOCKS} SELECT * FROM message_events")
def message_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = N.message_events(message_log(spark, sf_dir))
    return got.select("session_id", "event_id", "line_no", "block_pos", "event_type", "subtype", "role", "content", "content_len", "tool_name", "tool_input", "tool_output", "timestamp", "file_path", "source_file")


@query(f"WITH {_BLOCKS} SELECT event_type, subtype, count(*) AS cnt FROM message_events GROUP BY ALL")
def event_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.message_events(message_log(spark, sf_dir)).groupBy("event_type", "subtype").agg(F.count("*").alias("cnt"))


@query(f"WITH {_BLOCKS} SELECT session_id, line_no, pos, role AS kind, block_type, tool_follows FROM blocks")
def explode_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.message_blocks(message_log(spark, sf_dir)).select(F.col("session").alias("session_id"), "line_no", "pos", "kind", "block_type", "tool_follows")


@query(f"WITH {_BLOCKS} SELECT conv_id, turn, coalesce(bool_or(tool_follows), false) AS follows FROM blocks GROUP BY ALL")
def turn_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = N.message_blocks(message_log(spark, sf_dir))
    return b.groupBy(F.substring("session", 2, 20).cast("long").alias("conv_id"), (F.col("line_no") - 1).alias("turn")).agg(F.max("tool_follows").alias("follows"))


@query(f"WITH {_BLOCKS} SELECT '/logs/s' || conv_id || '.jsonl' AS file_path, 'c' || call_turn AS call_id, call_name FROM called")
def pair_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.call_names(N.message_blocks(message_log(spark, sf_dir)))


@query(f"""WITH {_BLOCKS} SELECT session_id AS id, 'Claude' AS source, 'Code' AS type, coalesce(min(timestamp), 5000) AS started_at, coalesce(max(timestamp), 5000) AS ended_at, '/w' AS project_path
FROM message_events GROUP BY session_id""")
def session_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = message_log(spark, sf_dir)
    files = log.select(F.col("file_path").alias("source_file"), "mtime", F.lit("/w").alias("project_path"), F.lit(None).cast("string").alias("metadata")).distinct()
    return sessions_of(N.message_events(log), files).select("id", "source", "type", "started_at", "ended_at", "project_path")


@query(f"""WITH {_BLOCKS} SELECT session_id, line_no, tool_name, '' AS description, CASE WHEN tool_name = 'Task' THEN 'look ' || (line_no - 1) ELSE '' END AS prompt, '' AS subagent
FROM message_events WHERE event_type = 'tool_call' AND tool_name ILIKE '%task%'""")
def task_invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = reports.task_invocations(N.message_events(message_log(spark, sf_dir)))
    return got.select("session_id", F.col("event_id").cast("long").alias("line_no"), "tool_name", "description", "prompt", "subagent")


@query(f"""WITH {_BLOCKS}, o AS (SELECT CASE WHEN contains(lower(content), 'timeout') THEN 'timeout' WHEN contains(lower(content), 'not_ready') OR contains(lower(content), 'not ready') THEN 'not_ready'
    WHEN contains(lower(content), 'success') OR contains(lower(content), 'completed') THEN 'success' ELSE 'unknown' END AS outcome FROM message_events WHERE subtype = 'tool_result' AND tool_name ILIKE '%task%')
SELECT outcome, count(*) AS cnt FROM o GROUP BY outcome""")
def task_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.task_outcomes(N.message_events(message_log(spark, sf_dir)))


@query("""WITH e AS (SELECT *, '/logs/e' || conv_id || '.jsonl' AS source_file, CASE WHEN conv_id % 7 > 0 THEN 'sess-' || conv_id ELSE 'e' || conv_id END AS session_id,
    CASE WHEN role = 'system' THEN '{"why":"x' || conv_id || '"}' ELSE text || chr(10) || 'more' END AS said FROM conversations WHERE role <> 'assistant' OR turn % 4 <> 3)
SELECT session_id, CAST(turn + 2 AS VARCHAR) AS event_id, CASE role WHEN 'user' THEN 'user_message' ELSE 'assistant_message' END AS event_type,
  CASE role WHEN 'user' THEN CASE WHEN regexp_matches(said, '^\\s*/') THEN 'slash_command' ELSE 'prompt' END WHEN 'system' THEN 'dialog' ELSE 'response' END AS subtype,
  CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END AS role, CASE WHEN length(said) > 2000 THEN substring(said, 1, 1999) || '…' ELSE said END AS content, length(said) AS content_len,
  CAST(1700000000000 + turn * 1000 AS DOUBLE) AS timestamp, CASE WHEN role = 'system' THEN '{"event_msg_type":"turn_aborted"}' END AS metadata, source_file FROM e""")
def envelope_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = envelope_log(spark, sf_dir)
    got = N.envelope_events(log, H.session_headers(log))
    return got.select("session_id", "event_id", "event_type", "subtype", "role", "content", "content_len", "timestamp", "metadata", "source_file")


@query("SELECT '/logs/e' || conv_id || '.jsonl' AS file_path, CASE WHEN conv_id % 7 > 0 THEN 'sess-' || conv_id END AS id, '/w/p' || conv_id % 5 AS cwd FROM (SELECT DISTINCT conv_id FROM conversations)")
def session_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.session_headers(envelope_log(spark, sf_dir))


@query("""WITH b AS (SELECT *, CASE WHEN turn > 0 THEN 1700000000000.0 - turn * 1000 END AS ts, CASE WHEN turn % 4 = 3 THEN ' ' ELSE text END AS said FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(ts, 0), turn) AS line_no FROM b),
t AS (SELECT * FROM n WHERE role IN ('user', 'assistant'))
SELECT 'c' || conv_id AS session_id, 'c' || conv_id || ':b' || turn AS event_id, line_no, 0 AS block_pos, CASE role WHEN 'user' THEN 'user_message' ELSE 'assistant_message' END AS event_type,
  CASE WHEN role = 'user' THEN CASE WHEN regexp_matches(said, '^\\s*/') THEN 'slash_command' ELSE 'prompt' END WHEN said = ' ' THEN 'dialog' ELSE 'response' END AS subtype,
  CASE WHEN length(said) > 2000 THEN substring(said, 1, 1999) || '…' ELSE said END AS content, length(said) AS content_len, NULL AS tool_name, CAST(ts AS DOUBLE) AS timestamp FROM t
UNION ALL SELECT 'c' || conv_id, 'c' || conv_id || ':b' || turn || ':tr' || i, line_no, i + 1, 'user_message', 'tool_result',
  CASE WHEN i = 1 THEN 'z' WHEN length(text) > 2000 THEN substring(text, 1, 1999) || '…' ELSE text END, CASE WHEN i = 1 THEN 1 ELSE length(text) END, CASE i WHEN 0 THEN 'Read' ELSE 'unknown' END, CAST(ts AS DOUBLE)
FROM t, range(2) r(i) WHERE role = 'assistant'""")
def bubble_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = N.bubble_events(bubbles(spark, sf_dir))
    return got.select("session_id", "event_id", "line_no", "block_pos", "event_type", "subtype", "content", "content_len", "tool_name", "timestamp")


def _filled_store(spark: SparkSession, sf_dir: str) -> Store:
    """A store that the message log is merged into twice: up to the fourth turn, and as a whole."""
    store = Store(spark, scratch_dir(spark, "store"), buckets=4)
    log = message_log(spark, sf_dir)
    files = log.select(F.col("file_path").alias("source_file"), "mtime", F.lit("/w").alias("project_path"), F.lit(None).cast("string").alias("metadata")).distinct()
    sources = log.groupBy(F.col("file_path").alias("source_key")).agg(F.max("mtime").alias("mtime"), F.max("size").alias("size"))
    for part in (log.filter("line_no <= 4"), log):
        events = N.message_events(part)
        store.merge(events, sessions_of(events, files), sources)
    return store


@query(f"""WITH {_BLOCKS}, last AS (SELECT * FROM message_events QUALIFY row_number() OVER (PARTITION BY {", ".join(c for c in EVENT_KEY if c != "source")} ORDER BY line_no DESC, block_pos DESC) = 1)
SELECT session_id, event_id, block_pos, event_type, subtype, content_len, tool_name, timestamp FROM last""")
def store_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled_store(spark, sf_dir).events().select("session_id", "event_id", "block_pos", "event_type", "subtype", "content_len", "tool_name", "timestamp")


@query(f"""WITH {_BLOCKS} SELECT 'Claude' AS source, count(DISTINCT session_id) AS sessions, count(DISTINCT (session_id, event_id)) AS events FROM message_events HAVING count(*) > 0""")
def store_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_counts(_filled_store(spark, sf_dir))


@query("SELECT '/logs/s' || conv_id || '.jsonl' AS file_path, CASE WHEN conv_id % 2 = 0 THEN 5.0 ELSE 6.0 END AS mtime FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 2 = 1")
def store_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all logs those that have changed since they were ingested."""
    store = _filled_store(spark, sf_dir)
    logs = message_log(spark, sf_dir).select("file_path", F.substring_index("file_path", "/s", -1).alias("name")).distinct()
    changed = F.split("name", "[.]")[0].cast("long") % 2 == 1
    return L.not_ingested(logs.select("file_path", F.when(changed, 6.0).otherwise(5.0).alias("mtime")), store.manifest())


# sources, over files that the tables are written to first


def plain_dir(spark: SparkSession, name: str) -> str:
    """scratch_dir as a path for Python's own files."""
    return re.sub("^file:/+", "/", scratch_dir(spark, name))


def _written(spark: SparkSession, rows: DataFrame, parts: int) -> DataFrame:
    """Text files of rows (part, below `parts`; place; line), one for each part; their listing, and part."""
    folder = scratch_dir(spark, "files")
    rows.repartition(parts, "part").sortWithinPartitions("part", "place").select("part", "line").write.partitionBy("part").text(folder)
    return L.listing(spark, folder, recursive=True, pattern="*.txt").withColumn("part", _part("file_path"))


def _part(path: str) -> F.Column:
    return F.regexp_extract(path, "part=([0-9]+)", 1).cast("long")


def _paths(files: DataFrame) -> list[str]:
    return [r["file_path"] for r in files.select("file_path").collect()]  # a row for each part


def _log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four logs of turns; every fourth turn is no JSON, every fifth an empty line."""
    turn = F.col("turn")
    line = F.when(turn % 5 == 4, "").when(turn % 4 == 3, "no record").otherwise(_members(conv=F.col("conv_id"), turn=turn, text=F.col("text")))
    c = table(spark, sf_dir, "conversations")
    return _written(spark, c.select((F.col("conv_id") % 4).alias("part"), F.struct("conv_id", "turn").alias("place"), line.alias("line")), 4)


_LOG = "log AS (SELECT *, conv_id % 4 AS part, row_number() OVER (PARTITION BY conv_id % 4 ORDER BY conv_id, turn) AS line_no FROM conversations)"


@query(f"WITH {_LOG} SELECT part, line_no, conv_id, turn, text FROM log WHERE turn % 5 <> 4 AND turn % 4 <> 3")
def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = L.records(L.numbered_lines(spark, _paths(_log_files(spark, sf_dir))))
    field = lambda name, kind: F.try_variant_get("record", f"$.{name}", kind)
    return r.select(_part("file_path").alias("part"), "line_no", field("conv", "long").alias("conv_id"), field("turn", "long").alias("turn"), field("text", "string").alias("text"))


@query(f"WITH {_LOG} SELECT part, count(*) AS rejected FROM log WHERE turn % 5 <> 4 AND turn % 4 = 3 GROUP BY part")
def log_lines_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rejected(L.numbered_lines(spark, _paths(_log_files(spark, sf_dir)))).select(_part("file_path").alias("part"), "rejected")


@query("""WITH f AS (SELECT user_id % 8 AS part, CAST(sum(length(event_type) + 1) AS BIGINT) AS size FROM events GROUP BY 1)
SELECT part, size, true AS dated FROM f WHERE size >= (SELECT CAST(avg(size) AS BIGINT) FROM f)""")
def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of eight files those of the average size or more."""
    e = table(spark, sf_dir, "events")
    files = _written(spark, e.select((F.col("user_id") % 8).alias("part"), F.col("event_id").alias("place"), F.col("event_type").alias("line")), 8)
    least = files.agg(F.round(F.avg("size")).cast("long").alias("least")).first()["least"]
    return L.large_enough(files, least or 0).select("part", "size", (F.col("mtime") > 1.7e9).alias("dated"))


@query("SELECT CAST(n_regionkey AS BIGINT) AS part, '/w/' || n_name AS \"projectPath\", CAST(n_nationkey AS VARCHAR) AS \"sessionId\", CASE WHEN n_nationkey % 3 > 0 THEN CAST(n_nationkey * 1000 AS DOUBLE) END AS \"fileMtime\", CAST(n_nationkey AS BIGINT) AS \"messageCount\", n_nationkey % 4 = 0 AS \"isSidechain\" FROM nation")
def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index for each region, which lists its nations."""
    key = F.col("n_nationkey")
    entry = F.struct(F.concat(F.lit("/w/"), "n_name").alias("projectPath"), key.cast("string").alias("sessionId"), F.when(key % 3 > 0, key * 1000).alias("fileMtime"), key.alias("messageCount"), (key % 4 == 0).alias("isSidechain"))
    docs = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("part")).agg(_members(version=F.lit(1), entries=F.collect_list(entry)).alias("line"))  # 25 nations
    files = _written(spark, docs.withColumn("place", F.lit(0)), 5)
    return H.session_index(spark, _paths(files)).select(_part("index_path").alias("part"), "projectPath", "sessionId", "fileMtime", "messageCount", "isSidechain")


@query("SELECT CAST(n_nationkey AS BIGINT) AS part, '/w/' || n_name AS folder FROM nation WHERE n_nationkey % 3 < 2")
def workspace_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A descriptor for each nation: its folder is a text, an object, or not there."""
    key, uri = F.col("n_nationkey"), F.concat(F.lit("file:///w/"), "n_name")
    line = F.when(key % 3 == 0, _members(folder=uri)).when(key % 3 == 1, _members(folder=F.struct(uri.alias("path")))).otherwise("{}")
    files = _written(spark, table(spark, sf_dir, "nation").select(key.alias("part"), F.lit(0).alias("place"), line.alias("line")), 25)
    return H.workspaces(spark, _paths(files)).select(_part("descriptor").alias("part"), "folder")


@query("""WITH f AS (SELECT *, n_nationkey % 7 AS part, row_number() OVER (PARTITION BY n_nationkey % 7 ORDER BY n_nationkey) AS line_no FROM nation)
SELECT CAST(part AS BIGINT) AS part, '/w/' || n_name AS cwd, CAST(CASE WHEN part % 3 < 2 THEN 1700000000000 + CAST(n_nationkey AS BIGINT) * 1000 ELSE 0 END AS DOUBLE) AS ts FROM f WHERE line_no = 1 AND part < 6""")
def first_line_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven logs whose every line is a header, but for the last log; only first lines count."""
    key = F.col("n_nationkey")
    part, seconds = key % 7, F.lit(1_700_000_000) + key
    payload = F.struct(F.concat(F.lit("/w/"), "n_name").alias("cwd"))
    kind = F.when(part == 6, "event_msg").otherwise("session_meta")
    line = (
        F.when(part % 3 == 0, _members(type=kind, timestamp=seconds.cast("long"), payload=payload))
        .when(part % 3 == 1, _members(type=kind, timestamp=F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'"), payload=payload))
        .otherwise(_members(type=kind, payload=payload))
    )
    files = _written(spark, table(spark, sf_dir, "nation").select(part.alias("part"), key.alias("place"), line.alias("line")), 7)
    return H.first_line_headers(spark, _paths(files)).select(_part("file_path").alias("part"), "cwd", "ts")


def _kv_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """Key/value stores, one from each of four tasks.

    Messages' values are JSON, every sixth in base64, every sixth no JSON and
    every sixth null; a composer has a conversation, a folder, or a null value.
    """
    folder, turn, conv = plain_dir(spark, "kv"), F.col("turn"), F.col("conv_id")
    c = table(spark, sf_dir, "conversations")
    data = _members(type=F.lit(1), text=F.col("text"))
    value = F.when(turn % 6 == 4, F.base64(F.encode(data, "utf-8"))).when(turn % 6 == 3, "junk{").when(turn % 6 != 5, data)
    said = c.select("conv_id", F.concat(F.lit("bubbleId:c"), conv.cast("string"), F.lit(":b"), turn.cast("string")).alias("key"), value.alias("value"))
    known = F.when(conv % 3 == 0, _members(conversation=F.array(F.lit(1)), projectPath=F.concat(F.lit("/w/p"), (conv % 5).cast("string")))).when(conv % 3 == 1, _members(conversation=F.array().cast("array<int>"), folder=F.lit("/f")))
    composers = c.select("conv_id").distinct().select("conv_id", F.concat(F.lit("composerData:c"), conv.cast("string")).alias("key"), known.alias("value"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/{uuid.uuid4().hex}.vscdb"  # of its own for each attempt; only those of finished tasks are named
        with sqlite3.connect(path) as db:
            db.execute("CREATE TABLE cursorDiskKV (key TEXT UNIQUE ON CONFLICT REPLACE, value BLOB)")
            for b in batches:
                db.executemany("INSERT INTO cursorDiskKV VALUES (?, ?)", zip(b.column("key").to_pylist(), b.column("value").to_pylist()))
        db.close()
        yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    rows = said.unionByName(composers).repartition(4, "conv_id").select("key", "value")
    return [r["path"] for r in rows.mapInArrow(write, "path string").collect()]  # four rows


@query("SELECT 'c' || conv_id AS composer_id, 'b' || turn AS bubble_id, text AS said FROM conversations WHERE turn % 6 NOT IN (3, 5)")
def kv_bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.bubbles(spark, _kv_files(spark, sf_dir)).select("composer_id", "bubble_id", F.try_variant_get("data", "$.text", "string").alias("said"))


@query("SELECT count(DISTINCT conv_id) AS sessions, count(*) AS events FROM conversations")
def kv_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.metrics(spark, _kv_files(spark, sf_dir)).agg(F.sum("sessions").alias("sessions"), F.sum("events").alias("events"))


@query("""SELECT 'c' || conv_id AS composer_id, conv_id % 3 = 2 AS value_null, false AS decode_error, conv_id % 3 = 0 AS has_conversation, CASE WHEN conv_id % 3 = 1 THEN '/f' END AS folder,
  CASE WHEN conv_id % 3 = 0 THEN '/w/p' || conv_id % 5 END AS "projectPath", CASE conv_id % 3 WHEN 0 THEN 'conversation,projectPath' WHEN 1 THEN 'conversation,folder' END AS top_keys FROM (SELECT DISTINCT conv_id FROM conversations)""")
def kv_composers(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = K.composers(spark, _kv_files(spark, sf_dir)).withColumn("top_keys", F.array_join("top_keys", ","))
    return got.select("composer_id", "value_null", "decode_error", "has_conversation", "folder", "projectPath", "top_keys")


@query("""WITH s AS (SELECT '/' || source AS path, count(*) AS n, sum(n_chars) AS chars, bool_or(lang = 'es') AS seen FROM documents GROUP BY source)
SELECT path, CASE WHEN path LIKE '%3' THEN '2025-01-01' END AS last_ingestion, CASE WHEN path LIKE '%3' THEN n END AS ingested, CASE WHEN path NOT LIKE '%2' THEN n END AS sessions, CASE WHEN path NOT LIKE '%2' THEN CAST(chars AS BIGINT) END AS events,
  CASE WHEN seen THEN '2025-01-03' END AS last_seen, CASE WHEN path LIKE '%3' THEN '2025-01-01' WHEN path NOT LIKE '%2' THEN '2025-01-02' ELSE '' END AS shown FROM s WHERE path LIKE '%3' OR path NOT LIKE '%2' OR seen""")
def registry_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry after an ingest, a query and a walk, saved and read back."""
    d = table(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("/"), "source"))
    per = d.groupBy("path").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    one = F.struct(F.col("n").alias("sessions"), F.col("chars").cast("long").alias("events"), F.lit("2025-01-01").alias("last_ingestion"))
    empty = spark.createDataFrame([], REGISTRY_SCHEMA)
    got = R.merge_sources(empty, per.filter("path LIKE '%3'").select("path", F.create_map(F.lit("CC"), one).alias("new_sources")), "2025-01-01")
    got = R.merge_query(got, per.filter("path NOT LIKE '%2'").select("path", F.col("n").alias("n_sessions"), F.col("chars").cast("long").alias("n_events")), "2025-01-02")
    got = R.mark_seen(got, d.filter("lang = 'es'").select("path"), "2025-01-03")
    folder = plain_dir(spark, "registry")
    R.save(got, folder, "2025-01-04")
    return R.load(spark, folder).select("path", "last_ingestion", F.col("sources")["CC"]["sessions"].alias("ingested"), "query.sessions", "query.events", "walk.last_seen", R.shown_time().alias("shown"))


@query("SELECT '/' || source AS full_path, lang AS vendor, count(*) AS sess, round(sum(n_chars) / 1048576, 2) AS mb FROM documents GROUP BY source, lang")
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan's rows, written as CSV and read back."""
    path = f"{plain_dir(spark, 'csv')}/scan.csv"
    write_csv(_scan_rows(spark, sf_dir), ["full_path", "vendor", "sess", "mb", "span_weeks"], path)
    return spark.read.csv(path, header=True, schema="full_path string, vendor string, sess long, mb double, span_weeks double").drop("span_weeks")


# text

_DIRTY = "concat(text, chr(13), chr(10), chr(27), '[1;31mred', chr(27), '[0m', chr(13), chr(0), 'x', chr(9), chr(7), chr(127), 'y')"


@query(f"""SELECT doc_id, regexp_replace(regexp_replace(replace(replace({_DIRTY}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\x1b\\[[0-9;]*[a-zA-Z]', '', 'g'),
  '[\\x00-\\x08\\x0b-\\x1f\\x7f]', '', 'g') AS cleaned FROM documents""")
def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.sanitize(F.expr(_DIRTY)).alias("cleaned"))


_CLEAN_SQL = f"""regexp_replace(regexp_replace(replace(replace({_DIRTY}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\x1b\\[[0-9;]*[a-zA-Z]', '', 'g'), '[\\x00-\\x08\\x0b-\\x1f\\x7f]', '', 'g')"""


@query(f"WITH c AS (SELECT doc_id, {_CLEAN_SQL} AS text FROM documents) SELECT doc_id, CASE WHEN length(text) > 512 THEN substring(text, 1, 511) || '…' ELSE text END AS shown FROM c")
def display_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.for_display(F.encode(F.expr(_DIRTY), "utf-8")).alias("shown"))


# the escape in the middle of the secret goes before secrets are looked for
_HIDDEN = "concat(text, chr(13), ' sk-abcdefghij', chr(27), '[0m', repeat('k9', 8), ' sk-short')"


@query(f"""WITH c AS (SELECT doc_id, regexp_replace(replace(replace({_HIDDEN}, chr(13), chr(10)), chr(27) || '[0m', ''), '[\\x00-\\x08\\x0b-\\x1f\\x7f]', '', 'g') AS text FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?i)sk-[a-z0-9]{{20,}}', '[REDACTED]', 'g'),
  '(?i)api[_-]?key["'']?\\s*[:=]\\s*["'']?[a-z0-9_\\-]{{20,}}', '[REDACTED]', 'g'), '(?i)bearer\\s+[a-z0-9_\\-.]{{20,}}', '[REDACTED]', 'g') AS cleaned FROM c""")
def clean_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.clean(F.expr(_HIDDEN), hide_secrets=True).alias("cleaned"))


_SECRET = "concat(text, ' sk-', repeat('a1', 12), ' API_KEY = \"', repeat('Zz9_', 6), '\" Bearer  ', repeat('q.-', 9), ' sk-short')"


@query(f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({_SECRET}, '(?i)sk-[a-z0-9]{{20,}}', '[REDACTED]', 'g'),
  '(?i)api[_-]?key["'']?\\s*[:=]\\s*["'']?[a-z0-9_\\-]{{20,}}', '[REDACTED]', 'g'), '(?i)bearer\\s+[a-z0-9_\\-.]{{20,}}', '[REDACTED]', 'g') AS hidden FROM documents""")
def redact_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.redact(F.expr(_SECRET)).alias("hidden"))


@query("""SELECT doc_id, regexp_replace(text, 'token\\s*=\\s*"[0-9a-f]{20,}"', '[REDACTED]', 'g') AS hidden FROM documents""")
def redact_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.redact(F.col("text"), [r'token\s*=\s*"[0-9a-f]{20,}"']).alias("hidden"))


def _cut_sql(limit: int) -> str:
    return f"CASE WHEN length(text) > {limit} THEN substring(text, 1, {limit - 1}) || '…' ELSE text END"


@query(f"SELECT doc_id, {_cut_sql(2000)} AS cut, length(text) AS full_len FROM documents")
def truncate_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.truncate(F.col("text"), 2000).alias("cut"), X.full_length(F.col("text")).alias("full_len"))


@query(f"SELECT conv_id, turn, {_cut_sql(200)} AS cut FROM conversations")
def truncate_dialog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.truncate(F.col("text"), 200).alias("cut"))


_LOOSE = "concat('  ', text, repeat(chr(10), 4), chr(9), ' end ', chr(10))"


@query(f"SELECT doc_id, trim(regexp_replace(regexp_replace({_LOOSE}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' ' || chr(9) || chr(10)) AS tidy FROM documents")
def normalize_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.normal_prompt(F.expr(_LOOSE)).alias("tidy"))


@query(f"SELECT doc_id, list_aggregate(list_filter([rtrim(x, ' ' || chr(9)) FOR x IN string_split({_LOOSE}, chr(10))], lambda x: x <> ''), 'string_agg', chr(10)) AS tidy FROM documents")
def normalize_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.normal_response(F.expr(_LOOSE)).alias("tidy"))


@query("""SELECT event_id, '{"path":"/p' || user_id || '","offset":' || json_extract_string(props, '$.k') || '}' AS kept, '/p' || user_id AS file_path, json_extract_string(props, '$.k') AS k FROM events""")
def extract_tool_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    raw = F.concat(F.lit('{"junk": [1], "offset": '), k, F.lit(', "path": "/p'), F.col("user_id").cast("string"), F.lit('"}'))
    kept = Tl.tool_input(F.lit("Read"), F.parse_json(raw), raw)
    return table(spark, sf_dir, "events").select("event_id", kept.alias("kept"), Tl.input_field(kept, "path").alias("file_path"), k.alias("k"))


# times


@query("""SELECT event_id, epoch_us(ts) / 1000.0 AS from_text, CASE WHEN user_id % 2 = 0 THEN epoch_us(ts) // 1000000 * 1000.0 ELSE epoch_us(ts) / 1000.0 END AS scaled,
  round((1893456000000.0 - epoch_us(ts) / 1000.0) / 86400000, 1) AS days_ago FROM events""")
def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    number = F.when(F.col("user_id") % 2 == 0, F.floor(us / 1000000).cast("double")).otherwise(us / F.lit(1000.0))
    return table(spark, sf_dir, "events").select("event_id", C.iso_ms(iso).alias("from_text"), C.seconds_or_ms(number).alias("scaled"), C.days_ago(us / F.lit(1000.0), 1893456000000.0).alias("days_ago"))


_STAMPS = """CASE user_id % 5 WHEN 0 THEN '{"timestamp":' || ms || '}' WHEN 1 THEN '{"timestamp":"' || iso || '"}' WHEN 2 THEN '{"message":{"timestamp":"' || iso || '"}}'
  WHEN 3 THEN '{"timestamp":0,"message":{"timestamp":' || ms || '}}' ELSE '{"timestamp":"soon","message":{"timestamp":' || ms || '}}' END"""


@query("""WITH e AS (SELECT event_id, user_id % 5 AS k, CAST(epoch_us(ts) // 1000 AS DOUBLE) AS ms FROM events)
SELECT event_id, CASE WHEN k < 4 THEN ms END AS of_record, CASE k WHEN 0 THEN ms WHEN 3 THEN 0 END AS of_envelope, CASE WHEN k < 2 THEN ms WHEN k = 3 THEN 0 END AS of_scan FROM e""")
def record_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of records: numbers, texts, those of the message, and ones that can't be read."""
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    e = table(spark, sf_dir, "events").select("event_id", "user_id", ms.alias("ms"), F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"))
    v = e.select("event_id", F.parse_json(F.expr(_STAMPS)).alias("v"))
    own = F.try_variant_get("v", "$.timestamp", "variant")
    return v.select("event_id", C.record_ms(F.col("v")).alias("of_record"), C.envelope_ms(own).alias("of_envelope"), C.envelope_ms(own, read_text=True).alias("of_scan"))


# merges


@query("""WITH new AS (SELECT conv_id, turn, role, 'new ' || text AS text FROM conversations WHERE turn % 2 = 1 UNION ALL SELECT conv_id + 1000000, turn, role, text FROM conversations WHERE turn = 0)
SELECT conv_id, turn, role, text FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.conv_id = c.conv_id AND n.turn = c.turn) UNION ALL SELECT * FROM new""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lit(0).alias("seq"))
    odd = old.filter("turn % 2 = 1")
    first = odd.withColumns({"text": F.lit("overwritten"), "seq": F.lit(1)})
    again = odd.withColumns({"text": F.concat(F.lit("new "), "text"), "seq": F.lit(2)})
    added = old.filter("turn = 0").withColumn("conv_id", F.col("conv_id") + 1000000)
    return merge_rows(old, first.unionByName(again).unionByName(added), ["conv_id", "turn"], ["seq"]).drop("seq")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_of_key(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT 'f' || d.doc_id AS file_path, d.n_chars % 2 AS mtime, d.n_chars AS size FROM documents d WHERE n_chars >= 100 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = d.n_chars % 2)")
def incremental_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    files = table(spark, sf_dir, "documents").select(name.alias("file_path"), (F.col("n_chars") % 2).cast("double").alias("mtime"), F.col("n_chars").alias("size"))
    manifest = table(spark, sf_dir, "labels").select(name.alias("source_key"), F.col("quality").cast("double").alias("mtime"))
    return L.not_ingested(L.large_enough(files, 100), manifest)


def _scan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan result for each source: documents stand for sessions."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source", "lang").agg(F.count("*").alias("sess"), C.megabytes(F.sum("n_chars")).alias("mb")).select(F.concat(F.lit("/"), "source").alias("full_path"), F.col("lang").alias("vendor"), "sess", "mb", F.lit(None).cast("double").alias("span_weeks"))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry that knows the sources whose name ends in an odd digit."""
    paths = table(spark, sf_dir, "documents").select(F.concat(F.lit("/"), "source").alias("path")).distinct().filter(F.col("path").rlike("[13579]$"))
    base = paths.select("path", *(F.lit(None).cast(f.dataType).alias(f.name) for f in REGISTRY_SCHEMA.fields[1:]))
    return base.withColumn("last_query", F.lit("2024-01-01"))


@query("""SELECT '/' || source AS full_path, lang AS vendor, count(*) AS sess, '2024-01-01' AS reg_updated FROM documents WHERE regexp_matches(source, '[13579]$') GROUP BY source, lang""")
def registry_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_registry(_scan_rows(spark, sf_dir), _registry(spark, sf_dir)).select("full_path", "vendor", "sess", "reg_updated")


@query("""WITH s AS (SELECT '/' || source AS path, lang, count(*) AS sess FROM documents WHERE lang <> 'es' OR source <> 'src1' GROUP BY ALL)
SELECT path, CASE WHEN regexp_matches(path, '[13579]$') THEN '2024-01-01' END AS last_query, '2025-01-01' AS last_scan,
  string_agg(lang || '=' || sess, ',' ORDER BY lang) AS vendors, count(*) AS n FROM s GROUP BY path""")
def registry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scan_rows(spark, sf_dir).filter("vendor <> 'es' OR full_path <> '/src1'")
    got = R.merge_scan(_registry(spark, sf_dir), rows, "2025-01-01")
    pairs = F.array_sort(F.transform(F.map_entries("scan.by_vendor"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["sess"].cast("string"))))
    return got.select("path", "last_query", "last_scan", F.array_join(pairs, ",").alias("vendors"), F.size("scan.by_vendor").cast("long").alias("n"))


# discovery


@query(f"WITH {_PATHS} SELECT path FROM paths p WHERE NOT EXISTS (SELECT 1 FROM paths q WHERE starts_with(q.path, p.path || '/'))")
def canonical_leaf_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.leaf_paths(page_paths(spark, sf_dir))


@query(f"""WITH {_PATHS}, more AS (SELECT path FROM paths UNION SELECT regexp_replace(path, '/[^/]*$', '') FROM paths WHERE path LIKE '%7')
SELECT path FROM more p WHERE NOT EXISTS (SELECT 1 FROM more q WHERE starts_with(p.path, q.path || '/'))""")
def canonical_root_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_paths(spark, sf_dir)
    more = p.union(p.filter("path LIKE '%7'").select(F.regexp_replace("path", "/[^/]*$", ""))).distinct()
    return D.root_paths(more)


@query(f"WITH {_PATHS} SELECT path, '-' || replace(substring(path, 2), '/', '-') AS slug, '/' || replace(replace(substring(path, 2), '/', '-'), '-', '/') AS decoded FROM paths")
def path_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_paths(spark, sf_dir)
    return p.select("path", P.path_slug(F.col("path")).alias("slug"), P.slug_path(P.path_slug(F.col("path"))).alias("decoded"))


@query(f"""WITH {_PATHS}, r AS (SELECT *, regexp_extract(path, '^/[^/]+', 0) || '/en' AS folder FROM paths)
SELECT path, path = folder OR starts_with(path, folder || '/') AS below, substring(path, 2) AS rel FROM r""")
def project_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths are a project's folder, or lie in it at a folder boundary."""
    p = page_paths(spark, sf_dir)
    folder = F.concat(F.regexp_extract("path", "^/[^/]+", 0), F.lit("/en"))
    return p.select("path", P.is_below(F.col("path"), folder).alias("below"), P.relative(F.concat(F.lit("/w"), "path"), "/w").alias("rel"))


_MOVED = "CASE page_id % 6 WHEN 0 THEN 'OLD/' || page_id WHEN 1 THEN 'a/OLD/b' || page_id WHEN 2 THEN 'Saved' || page_id WHEN 3 THEN 'MCP/MCPs' WHEN 4 THEN 'Claude' ELSE 'ok/' || page_id END"


@query(f"""WITH r AS (SELECT page_id, {_MOVED} AS rel FROM pages)
SELECT page_id, rel, contains(rel, '/OLD/') OR starts_with(rel, 'OLD/') OR starts_with(rel, 'Save') OR contains(rel, '/Save') OR rel = 'MCP/MCPs' AS excluded, rel = 'Claude' AS aggregator FROM r""")
def excluded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.concat(F.lit("/w/"), F.expr(_MOVED))
    rel = P.relative(full, "/w")
    return table(spark, sf_dir, "pages").select("page_id", rel.alias("rel"), P.is_excluded(rel).alias("excluded"), P.is_aggregator(rel).alias("aggregator"))


@query("""SELECT '/w/' || source AS path, string_agg(v, '|' ORDER BY v) AS vendor FROM (
  SELECT DISTINCT source, CASE lang WHEN 'en' THEN 'CC' WHEN 'de' THEN 'Codex' ELSE 'Cursor' END AS v FROM documents) GROUP BY source""")
def vendor_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lang = F.col("lang")
    parts = [d.filter(own).select(F.concat(F.lit("/w/"), "source").alias("path"), F.lit(v).alias("vendor")) for own, v in ((lang == "en", "CC"), (lang == "de", "Codex"), (~lang.isin("en", "de"), "Cursor"))]
    return D.canonical(parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct(), "/w").select("path", "vendor")


_NOW, _DAYS = 1706659200000, 20  # the last of the events' days, and a window that cuts the first ones off


@query(f"""WITH e AS (SELECT user_id % 40 AS p, epoch_us(ts) / 1000.0 AS ms, user_id, event_id, event_type, CASE event_type WHEN 'view' THEN 'k' WHEN 'click' THEN 'b' ELSE 'a' END AS v FROM events),
recent AS (SELECT * FROM e WHERE ms >= {_NOW} - {_DAYS} * 86400000.0),
a AS (SELECT p, count(*) AS n, sum(event_id) AS bytes, min(ms) AS lo, max(ms) AS hi FROM recent WHERE v = 'a' AND event_type <> 'error' GROUP BY p),
b AS (SELECT p, count(*) AS n, sum(event_id) AS bytes, min(ms) AS lo, max(ms) AS hi FROM recent WHERE v = 'b' GROUP BY p),
k AS (SELECT p, sum(s) AS n, sum(size) AS bytes FROM (SELECT p, user_id, count(DISTINCT event_id % 5) AS s, max(event_id) AS size FROM e WHERE v = 'k' GROUP BY p, user_id) GROUP BY p),
found AS (SELECT p, string_agg(DISTINCT CASE v WHEN 'a' THEN 'CC' WHEN 'b' THEN 'Codex' ELSE 'Cursor' END, '|' ORDER BY CASE v WHEN 'a' THEN 'CC' WHEN 'b' THEN 'Codex' ELSE 'Cursor' END) AS vendor, bool_or(v = 'k') AS kv FROM e GROUP BY p)
SELECT 'p' || p AS path, '/w/p' || p AS dir_path, vendor, CAST(coalesce(a.n, 0) + coalesce(b.n, 0) + coalesce(k.n, 0) AS BIGINT) AS sess,
  coalesce(round(a.bytes / 1048576, 2), 0) + coalesce(round(b.bytes / 1048576, 2), 0) + coalesce(round(k.bytes / 1048576, 2), 0) AS mb,
  coalesce(nullif(CASE WHEN a.hi > a.lo THEN round((a.hi - a.lo) / 604800000, 1) END, 0), CASE WHEN b.hi > b.lo THEN round((b.hi - b.lo) / 604800000, 1) END) AS span_weeks
FROM found LEFT JOIN a USING (p) LEFT JOIN b USING (p) LEFT JOIN k USING (p) WHERE kv OR a.p IS NOT NULL OR b.p IS NOT NULL""")
def project_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a session: views are those of a store, clicks of envelope logs, all others of an index, errors being sidechains."""
    kind = F.when(F.col("event_type") == "view", "Cursor").when(F.col("event_type") == "click", "Codex").otherwise("CC")
    path = F.concat(F.lit("/w/p"), (F.col("user_id") % 40).cast("string"))
    e = table(spark, sf_dir, "events").select(path.alias("project"), kind.alias("vendor"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000.0)).alias("ms"), "user_id", "event_id", "event_type", F.col("event_id").cast("string").alias("file_path"))
    entries = e.filter("vendor = 'CC'").select(F.col("project").alias("projectPath"), F.col("ms").alias("fileMtime"), (F.col("event_id") % 10).alias("messageCount"), (F.col("event_type") == "error").alias("isSidechain"), F.col("file_path").alias("fullPath"))
    a = D.index_metrics(entries, e.select("file_path", F.col("event_id").alias("size")), _DAYS, _NOW)
    logs = e.filter("vendor = 'Codex'").select("file_path", F.col("event_id").alias("size"), F.col("project").alias("cwd"), F.col("ms").alias("ts"))
    b = D.header_metrics(logs, logs.select("file_path", F.lit(3).alias("events")), _DAYS, _NOW)
    kv = e.filter("vendor = 'Cursor'").groupBy("project", "user_id").agg(F.countDistinct(F.col("event_id") % 5).alias("sessions"), F.count("*").alias("events"), F.max("event_id").alias("size"))
    found = e.select(F.col("project").alias("path"), "vendor").distinct()
    return D.project_metrics(D.canonical(found, "/w"), a, b, D.store_metrics(kv), "/w", _DAYS, _NOW)


@query("SELECT role AS project, CAST(sum(n) AS BIGINT) AS sess, CAST(sum(events) AS BIGINT) AS events, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT role, conv_id % 3 AS store, count(DISTINCT conv_id) AS n, count(*) AS events, max(length(text)) AS size FROM conversations GROUP BY ALL) GROUP BY role")
def distinct_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("project"), (F.col("conv_id") % 3).alias("store")).agg(F.countDistinct("conv_id").alias("sessions"), F.count("*").alias("events"), F.max(F.length("text")).alias("size"))
    return D.store_metrics(per).select("project", "sess", F.col("events").cast("long").alias("events"), F.col("bytes").cast("long").alias("bytes"))


@query("SELECT full_path, sess FROM (SELECT '/' || source || '/' || lang AS full_path, count(*) AS sess, round(sum(n_chars) / 1048576, 2) AS mb FROM documents GROUP BY source, lang) WHERE sess >= 12 OR mb >= 0.05")
def worthy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scan_rows(spark, sf_dir).withColumn("full_path", F.concat_ws("/", "full_path", "vendor"))
    return D.worthy(rows, 12, 0.05).select("full_path", "sess")


@query("SELECT CAST(user_id AS VARCHAR) AS path, CAST(min((event_id + user_id * 3) % 97) AS INTEGER) AS root_no FROM events GROUP BY user_id")
def first_root_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("full_path"), ((F.col("event_id") + F.col("user_id") * 3) % 97).cast("int").alias("root_no")).distinct()
    return D.first_of_path(rows).select(F.col("full_path").alias("path"), "root_no")


@query("SELECT DISTINCT '/' || source || '/' || lang AS path FROM documents WHERE n_chars < 200 EXCEPT SELECT '/' || source || '/' || lang FROM documents WHERE n_chars > 8000")
def repositories_without_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("/"), "source", F.lit("/"), "lang"))
    return D.without_sessions(d.filter("n_chars < 200"), d.filter("n_chars > 8000"))


@query("SELECT path, sess, row_number() OVER (ORDER BY sess DESC, path) AS place FROM (SELECT '/' || source || '/' || lang AS path, count(*) AS sess FROM documents GROUP BY 1)")
def candidate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = table(spark, sf_dir, "documents").groupBy(F.concat(F.lit("/"), "source", F.lit("/"), "lang").alias("path")).agg(F.count("*").alias("sess"))
    return D.candidates(scan).withColumn("place", F.row_number().over(Window.orderBy(F.desc("sess"), "path")).cast("long"))  # a row for each project


@query("SELECT page_id, regexp_replace(regexp_extract(url, '([^/]+)$', 1), '(.)\\.[^.]+$', '\\1') AS session_id FROM pages")
def session_id_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", P.session_id(F.col("url")).alias("session_id"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
