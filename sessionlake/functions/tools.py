"""Tool calls: which input fields are kept, and what kind of tool a name is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PATTERN_LIMIT, PROMPT_LIMIT
from .text import truncate

# Fields kept of each tool's input, and the limit of those that are truncated.
KEPT_FIELDS = {
    "bash": ["command"],
    "read": ["path", "offset", "limit"],
    "edit": ["path", "old_len", "new_len", "content_len"],
    "write": ["path", "old_len", "new_len", "content_len"],
    "grep": ["pattern", "path", "output_mode", "glob"],
    "glob": ["pattern", "path"],
    "agent": ["subagent_type", "description", "prompt"],
    "task": ["subagent_type", "description", "prompt"],
    "mcp_task": ["subagent_type", "description", "prompt"],
    "skill": ["skill", "args"],
}
LIMITS = {("grep", "pattern"): PATTERN_LIMIT, ("agent", "prompt"): PROMPT_LIMIT, ("task", "prompt"): PROMPT_LIMIT, ("mcp_task", "prompt"): PROMPT_LIMIT}


def _member(raw: Column, tool: str, field: str) -> Column:
    """`"field":value` as JSON text, or null where the input lacks the field."""
    value = F.try_variant_get(raw, f"$.{field}", "variant")
    json = F.to_json(value)
    if limit := LIMITS.get((tool, field)):
        text = F.try_variant_get(raw, f"$.{field}", "string")
        is_text = F.schema_of_variant(value) == "STRING"
        quoted = F.regexp_replace(F.to_json(F.array(truncate(text, limit))), r"^\[|\]$", "")
        json = F.when(is_text & (F.length(text) > limit), quoted).otherwise(json)
    # a member that is JSON null is a value, one that is missing is none
    return F.when(value.isNotNull(), F.concat(F.lit(f'"{field}":'), F.coalesce(json, F.lit("null"))))


def tool_input(name: Column, raw: Column, raw_json: Column) -> Column:
    """JSON text of the kept fields; null where nothing is left.

    raw: the input as a variant; raw_json: its text as it came, which inputs of
    other tools keep.
    """
    low = F.lower(F.coalesce(name, F.lit("")))
    case = F
    for tool, fields in KEPT_FIELDS.items():
        inner = F.concat_ws(",", *[_member(raw, tool, f) for f in fields])
        case = case.when(low == tool, F.when(inner != "", F.concat(F.lit("{"), inner, F.lit("}"))))
    other = F.when(F.size(F.json_object_keys(raw_json)) > 0, raw_json)
    return case.otherwise(other)


def input_field(tool_input_json: Column, field: str) -> Column:
    return F.get_json_object(tool_input_json, f"$.{field}")


def is_task_like(name: Column) -> Column:
    """Any case of "task" within the name."""
    return F.ilike(name, F.lit("%task%"))


def is_task_name(name: Column) -> Column:
    return F.contains(name, F.lit("Task")) | (name == "mcp_task")


def is_agent(name: Column) -> Column:
    return is_task_name(name) | (name == "Agent")


def is_web(name: Column) -> Column:
    return F.contains(F.lower(name), F.lit("web"))
