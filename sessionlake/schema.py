"""Table schemas, enumerations and limits of the session store."""

from __future__ import annotations

from pyspark.sql import types as T

SESSION_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("release", T.StringType()),
        T.StructField("release_value", T.LongType()),
        T.StructField("started_at", T.DoubleType(), False),  # Unix milliseconds
        T.StructField("ended_at", T.DoubleType()),
        T.StructField("project_path", T.StringType()),
        T.StructField("metadata", T.StringType()),
    ]
)

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType(), False),
        T.StructField("session_id", T.StringType(), False),
        T.StructField("event_id", T.StringType(), False),
        T.StructField("event_type", T.StringType()),
        T.StructField("subtype", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("content_len", T.LongType()),  # code points before truncation
        T.StructField("content_ref", T.StringType()),
        T.StructField("tool_name", T.StringType()),
        T.StructField("tool_input", T.StringType()),
        T.StructField("tool_output", T.StringType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("source_raw", T.BinaryType()),
        T.StructField("line_no", T.LongType()),  # with block_pos: place in the source, which orders ties
        T.StructField("block_pos", T.IntegerType()),
    ]
)

MANIFEST_SCHEMA = T.StructType([T.StructField("source_key", T.StringType(), False), T.StructField("mtime", T.DoubleType()), T.StructField("size", T.LongType())])

VENDOR_STATS = T.StructType([T.StructField("sessions", T.LongType()), T.StructField("events", T.LongType()), T.StructField("last_ingestion", T.StringType())])
SCAN_STATS = T.StructType([T.StructField("sess", T.LongType()), T.StructField("mb", T.DoubleType()), T.StructField("span_weeks", T.DoubleType())])
REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("last_ingestion", T.StringType()),
        T.StructField("last_scan", T.StringType()),
        T.StructField("last_query", T.StringType()),
        T.StructField("sources", T.MapType(T.StringType(), VENDOR_STATS)),
        T.StructField("scan", T.StructType([T.StructField("by_vendor", T.MapType(T.StringType(), SCAN_STATS))])),
        T.StructField("query", T.StructType([T.StructField("sessions", T.LongType()), T.StructField("events", T.LongType())])),
        T.StructField("walk", T.StructType([T.StructField("last_seen", T.StringType())])),
    ]
)

INDEX_SCHEMA = T.StructType(
    [
        T.StructField(
            "entries",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("projectPath", T.StringType()),
                        T.StructField("sessionId", T.StringType()),
                        T.StructField("fileMtime", T.DoubleType()),
                        T.StructField("messageCount", T.LongType()),
                        T.StructField("isSidechain", T.BooleanType()),
                        T.StructField("fullPath", T.StringType()),
                    ]
                )
            ),
        )
    ]
)

SESSION_KEY = ["source", "id"]
EVENT_KEY = ["source", "session_id", "event_id"]

# The words that stored tables hold.
SOURCE_A, SOURCE_B, SOURCE_KV = "Claude", "Codex", "Cursor"
TYPE_OF = {SOURCE_A: "Code", SOURCE_B: "Code", SOURCE_KV: "IDE"}
TAXONOMY = {"tool_call": [], "user_message": ["prompt", "slash_command", "tool_result", "permission_denied"], "assistant_message": ["response", "dialog", "truncated"]}
STANDARD_TOOLS = ["Agent", "AskUserQuestion", "Bash", "Edit", "Glob", "Grep", "LS", "Read", "Skill", "Task", "TaskCreate", "TaskList", "TaskOutput", "TaskStop", "TaskUpdate", "TodoWrite", "Write"]
SKIPPED_RECORDS = ["file-history-snapshot", "last-prompt", "progress", "queue-operation"]

# Limits of stored text, in code points; source_raw in bytes.
RESPONSE_LIMIT = 2000
DIALOG_LIMIT = 200
TOOL_RESULT_LIMIT = 2000
PATTERN_LIMIT = 200
PROMPT_LIMIT = 2000
EVENT_MSG_LIMIT = 500
RAW_BYTES = 512
MIN_SIZE = 20 * 1024
RECENT_DAYS = 90

#: Session settings that the expressions rely on.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
}
