"""Vendor records to events (EVENT_SCHEMA), one function for each log format.

All three read a scan once, explode nested blocks, classify them with CASE
expressions and clean the text before it is truncated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import timeconv as C
from ..functions.paths import session_id
from ..functions.tools import input_field, tool_input
from ..schema import DIALOG_LIMIT, EVENT_MSG_LIMIT, EVENT_SCHEMA, PROMPT_LIMIT, RAW_BYTES, RESPONSE_LIMIT, SKIPPED_RECORDS, SOURCE_A, SOURCE_B, SOURCE_KV, TOOL_RESULT_LIMIT


def as_events(df: DataFrame, **columns: Column | None) -> DataFrame:
    """Rows in EVENT_SCHEMA; columns that aren't given are null."""
    return df.select(*(columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA.fields))


def _text(v: str | Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _raw(keep: bool) -> Column:
    return F.substring(F.encode("line", "UTF-8"), 1, RAW_BYTES) if keep else F.lit(None)


def message_blocks(recs: DataFrame) -> DataFrame:
    """One row for each content block of the user and assistant records of a message log.

    Adds session, kind (record type), role, ts, pos, block, block_type, and
    tool_follows: whether the record has a tool call after this block.
    """
    kind = _text("record", "$.type")
    content = F.try_variant_get("record", "$.message.content", "array<variant>")
    picked = recs.withColumn("kind", kind).filter(F.col("kind").isin("assistant", "user") & ~F.col("kind").isin(SKIPPED_RECORDS)).withColumn("blocks", content)
    last_call = F.array_max(F.transform("blocks", lambda b, i: F.when(_text(b, "$.type") == "tool_use", i)))
    rows = picked.withColumn("last_call", last_call).withColumn("ts", C.record_ms(F.col("record")))
    out = rows.select("*", F.posexplode("blocks").alias("pos", "block")).withColumn("block_type", _text("block", "$.type"))
    return out.withColumns(
        {
            "session": session_id(F.col("file_path")),
            "role": F.coalesce(_text("record", "$.message.role"), F.col("kind")),
            "tool_follows": F.coalesce(F.col("last_call") > F.col("pos"), F.lit(False)),
        }
    ).drop("blocks", "last_call")


def call_names(blocks: DataFrame) -> DataFrame:
    """file_path, call_id, call_name of the tool calls of each file; of equal ids the last one counts."""
    calls = blocks.filter((F.col("kind") == "assistant") & (F.col("block_type") == "tool_use"))
    named = calls.select("file_path", _text("block", "$.id").alias("call_id"), _text("block", "$.name").alias("call_name"), F.struct("line_no", "pos").alias("at"))
    return named.filter((F.col("call_id") != "") & (F.col("call_name") != "")).groupBy("file_path", "call_id").agg(F.max_by("call_name", "at").alias("call_name"))


def message_events(recs: DataFrame, hide_secrets: bool = False, keep_raw: bool = False, block_identity: bool = False) -> DataFrame:
    """Events of message logs (records with content blocks); tool results get the name of the call they answer."""
    blocks = message_blocks(recs).filter(F.col("block_type").isin("text", "tool_use", "tool_result"))
    results_id = F.when((F.col("kind") == "user") & (F.col("block_type") == "tool_result"), _text("block", "$.tool_use_id"))
    rows = blocks.withColumn("call_id", results_id).join(call_names(blocks), ["file_path", "call_id"], "left")

    is_text, is_call, is_result = (F.col("block_type") == t for t in ("text", "tool_use", "tool_result"))
    of_user = F.col("kind") == "user"
    parts = F.filter(F.try_variant_get("block", "$.content", "array<variant>"), lambda b: _text(b, "$.type") == "text")
    answer = F.coalesce(F.array_join(F.transform(parts, lambda b: F.coalesce(_text(b, "$.text"), F.lit(""))), "\n"), _text("block", "$.content"))
    full = X.clean(F.coalesce(F.when(is_result, answer).otherwise(_text("block", "$.text")), F.lit("")), hide_secrets)
    stop = _text("record", "$.message.stop_reason")
    subtype = F.when(of_user & is_text, X.user_subtype(full)).when(of_user, X.result_subtype(_truthy("block", "$.is_error"))).when(is_text, X.assistant_subtype(F.col("tool_follows"), stop))
    content = (
        F.when(is_result, X.truncate(full, TOOL_RESULT_LIMIT))
        .when(of_user, full)
        .when(F.col("tool_follows"), X.truncate(full, DIALOG_LIMIT))
        .otherwise(X.truncate(full, RESPONSE_LIMIT))
    )
    # a record's blocks are members of one array of the line's text, so an input keeps its own text
    input_json = F.get(F.from_json(F.get_json_object("line", "$.message.content"), "array<struct<input:string>>"), F.col("pos"))["input"]
    call_input = F.when(is_call, tool_input(_text("block", "$.name"), F.try_variant_get("block", "$.input", "variant"), input_json))
    kept = rows.filter(of_user & ~is_call | ~of_user & ~is_result).withColumn("call_input", call_input)
    event_id = F.col("line_no").cast("string")
    return as_events(
        kept,
        source=F.lit(SOURCE_A),
        session_id=F.col("session"),
        event_id=F.concat_ws(":", event_id, F.col("pos").cast("string")) if block_identity else event_id,
        event_type=F.when(is_call, "tool_call").when(of_user, "user_message").otherwise("assistant_message"),
        subtype=F.when(~is_call, subtype),
        role=F.col("role"),
        content=F.when(~is_call, content),
        content_len=F.when(~is_call, X.full_length(full)),
        tool_name=F.when(is_call, _text("block", "$.name")).when(is_result, F.col("call_name")),
        tool_input=F.col("call_input"),
        tool_output=F.when(is_result, content),
        timestamp=F.col("ts"),
        file_path=input_field(F.col("call_input"), "path"),
        source_file=F.col("file_path"),
        source_raw=_raw(keep_raw),
        line_no=F.col("line_no"),
        block_pos=F.col("pos"),
    )


def _truthy(v: str, path: str) -> Column:
    """Whether a member is set: not null, false, 0, or empty."""
    value = F.try_variant_get(v, path, "variant")
    return F.coalesce(~F.to_json(value).isin("false", "0", "0.0", '""', "null", "[]", "{}"), F.lit(False))


def envelope_events(recs: DataFrame, headers: DataFrame, hide_secrets: bool = False, keep_raw: bool = False, read_text_times: bool = False, with_assistant: bool = False) -> DataFrame:
    """Events of envelope logs (type and payload); headers names each file's session (session_headers)."""
    kind, item, role = _text("record", "$.type"), _text("record", "$.payload.type"), _text("record", "$.payload.role")
    blocks = F.filter(F.try_variant_get("record", "$.payload.content", "array<variant>"), lambda b: _text(b, "$.text").isNotNull() | (_text(b, "$.type") == "input_text"))
    said = X.clean(F.coalesce(F.array_join(F.transform(blocks, lambda b: F.coalesce(_text(b, "$.text"), F.lit(""))), "\n"), F.lit("")), hide_secrets)
    payload = F.get_json_object("line", "$.payload")
    note = X.clean(F.coalesce(F.get_json_object("line", "$.payload.info"), F.when(F.array_contains(F.json_object_keys(payload), "info"), "null"), payload, F.lit("{}")), hide_secrets)

    is_message = (kind == "response_item") & (item == "message")
    of_user = is_message & (role == "user")
    of_model = is_message & role.isin("developer", *(["assistant"] if with_assistant else []))
    is_note = (kind == "event_msg") & (F.coalesce(item, F.lit("")) != "token_count")
    rows = recs.filter(of_user | of_model | is_note).join(headers.select("file_path", F.col("id").alias("named")), "file_path", "left")
    return as_events(
        rows,
        source=F.lit(SOURCE_B),
        session_id=F.coalesce("named", session_id(F.col("file_path"))),
        event_id=F.col("line_no").cast("string"),
        event_type=F.when(of_user, "user_message").otherwise("assistant_message"),
        subtype=F.when(of_user, X.user_subtype(said)).when(of_model, "response").otherwise("dialog"),
        role=F.when(of_user, "user").otherwise("assistant"),
        content=F.when(of_user, X.truncate(said, PROMPT_LIMIT)).when(of_model, X.truncate(said, RESPONSE_LIMIT)).otherwise(X.truncate(note, EVENT_MSG_LIMIT)),
        content_len=F.when(is_note, X.full_length(note)).otherwise(X.full_length(said)),
        timestamp=C.envelope_ms(F.try_variant_get("record", "$.timestamp", "variant"), read_text_times),
        source_file=F.col("file_path"),
        metadata=F.when(is_note & (item != ""), F.to_json(F.struct(item.alias("event_msg_type")))),
        source_raw=_raw(keep_raw),
        line_no=F.col("line_no"),
        block_pos=F.lit(0),
    )


def bubble_events(bubbles: DataFrame, hide_secrets: bool = False) -> DataFrame:
    """Events of key/value messages: the message itself, and one for each tool result of a model's message."""
    kind = F.try_variant_get("data", "$.type", "int")
    clock = F.try_variant_get("data", "$.timingInfo.clientStartTime", "double")
    order = Window.partitionBy("db_path", "composer_id").orderBy(F.coalesce(clock, F.lit(0.0)), "pos")
    rows = bubbles.withColumns({"kind": kind, "ts": F.nullif(clock, F.lit(0.0)), "full": X.clean(F.coalesce(_text("data", "$.text"), F.lit("")), hide_secrets), "line_no": F.row_number().over(order).cast("long")})
    rows = rows.filter(F.col("kind").isin(1, 2)).withColumn("base_id", F.concat_ws(":", "composer_id", "bubble_id"))
    of_user = F.col("kind") == 1
    common = {"source": F.lit(SOURCE_KV), "session_id": F.col("composer_id"), "timestamp": F.col("ts"), "source_file": F.col("db_path"), "line_no": F.col("line_no")}
    messages = as_events(
        rows,
        **common,
        event_id=F.col("base_id"),
        event_type=F.when(of_user, "user_message").otherwise("assistant_message"),
        subtype=F.when(of_user, X.user_subtype(F.col("full"))).when(X.is_blank(F.col("full")), "dialog").otherwise("response"),
        role=F.when(of_user, "user").otherwise("assistant"),
        content=X.truncate(F.col("full"), PROMPT_LIMIT),
        content_len=X.full_length(F.col("full")),
        block_pos=F.lit(0),
    )
    results = rows.filter(~of_user).select("*", F.posexplode(F.try_variant_get("data", "$.toolResults", "array<variant>")).alias("i", "res"))
    said = X.clean(F.coalesce(_text("res", "$.result"), F.to_json(F.try_variant_get("res", "$.result", "variant")), F.lit("")), hide_secrets)
    return messages.unionByName(
        as_events(
            results,
            **common,
            event_id=F.concat(F.col("base_id"), F.lit(":tr"), F.col("i").cast("string")),
            event_type=F.lit("user_message"),
            subtype=F.lit("tool_result"),
            role=F.lit("user"),
            content=X.truncate(said, TOOL_RESULT_LIMIT),
            content_len=X.full_length(said),
            tool_name=F.coalesce(F.nullif(_text("res", "$.toolName"), F.lit("")), F.lit("unknown")),
            tool_output=X.truncate(said, TOOL_RESULT_LIMIT),
            block_pos=F.col("i") + 1,
        )
    )
