"""Text cleaning, limits and classification as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default patterns of secrets.
SECRET_PATTERNS = [
    r"(?i)sk-[a-z0-9]{20,}",
    r"(?i)api[_-]?key[\"']?\s*[:=]\s*[\"']?[a-z0-9_\-]{20,}",
    r"(?i)bearer\s+[a-z0-9_\-.]{20,}",
]
REDACTED = "[REDACTED]"
ELLIPSIS = "…"
WHITE = r"(?U)\s"


def sanitize(c: Column) -> Column:
    """Line ends become \\n; terminal escapes and control characters (but tab and newline) go."""
    lines = F.regexp_replace(c, "\r\n?", "\n")
    plain = F.regexp_replace(lines, "\x1b\\[[0-9;]*[a-zA-Z]", "")
    return F.regexp_replace(plain, r"[\x00-\x08\x0b-\x1f\x7f]", "")


def redact(c: Column, patterns: list[str] | None = None) -> Column:
    return reduce(lambda s, p: F.regexp_replace(s, p, REDACTED), patterns or SECRET_PATTERNS, c)


def clean(c: Column, hide_secrets: bool = False) -> Column:
    return redact(sanitize(c)) if hide_secrets else sanitize(c)


def for_display(raw: Column, limit: int = 512) -> Column:
    """Bytes or text as cleaned, truncated text; invalid bytes are replaced."""
    return truncate(sanitize(F.make_valid_utf8(raw.cast("string"))), limit)


def truncate(c: Column, limit: int) -> Column:
    """The text, or its first limit - 1 code points and an ellipsis; null gives the empty text."""
    if limit <= 0:
        return F.when(F.length(c) > 0, F.lit(ELLIPSIS)).otherwise(F.lit(""))
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 1), F.lit(ELLIPSIS))).otherwise(F.coalesce(c, F.lit("")))


def full_length(c: Column) -> Column:
    return F.coalesce(F.length(c), F.lit(0)).cast("long")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"{WHITE}*\\z|\\A{WHITE}+", "")


def is_slash_command(c: Column) -> Column:
    return F.coalesce(F.regexp_like(c, F.lit(r"(?U)\A\s*/")), F.lit(False))


def is_blank(c: Column) -> Column:
    return ~F.coalesce(F.regexp_like(c, F.lit(r"(?U)\S")), F.lit(False))


def user_subtype(c: Column) -> Column:
    return F.when(is_slash_command(c), "slash_command").otherwise("prompt")


def assistant_subtype(tool_follows: Column, stop_reason: Column) -> Column:
    return F.when(tool_follows, "dialog").when(F.coalesce(F.contains(stop_reason, F.lit("max_tokens")), F.lit(False)), "truncated").otherwise("response")


def result_subtype(is_error: Column) -> Column:
    return F.when(F.coalesce(is_error, F.lit(False)), "permission_denied").otherwise("tool_result")


def normal_prompt(c: Column) -> Column:
    """At most one empty line in a row, runs of blanks made one, no white space at the ends."""
    few = F.regexp_replace(F.coalesce(c, F.lit("")), "\n{3,}", "\n\n")
    return strip(F.regexp_replace(few, "[ \t]+", " "))


def normal_response(c: Column) -> Column:
    """Lines without trailing white space; empty lines go."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: F.regexp_replace(x, r"(?U)\s+\z", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


# Words by which a result's outcome is told, in order of precedence.
OUTCOMES = [("timeout", ["timeout"]), ("not_ready", ["not_ready", "not ready"]), ("success", ["success", "completed"])]


def outcome(c: Column, rules: list[tuple[str, list[str]]] = OUTCOMES, otherwise: str = "unknown") -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    case = F
    for name, words in rules:
        case = case.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), name)
    return case.otherwise(otherwise)


def head(c: Column, n: int) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, n)
