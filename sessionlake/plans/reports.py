"""Reports over sessions and events, as DataFrames; printing is the command line's business."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import tools as Tl
from ..functions.timeconv import DAY_MS
from ..schema import STANDARD_TOOLS, TAXONOMY


def stats(sessions: DataFrame, events: DataFrame) -> DataFrame:
    ones = sessions.select(F.lit(1).alias("s"), F.lit(0).alias("e")).unionByName(events.select(F.lit(0).alias("s"), F.lit(1).alias("e")))
    return ones.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("sessions"), F.coalesce(F.sum("e"), F.lit(0)).alias("events"))


def taxonomy(spark) -> DataFrame:
    rows = [(i, kind, sub) for i, (kind, sub) in enumerate((k, s) for k, subs in TAXONOMY.items() for s in (None, *subs))]
    return spark.createDataFrame(rows, "pos int, event_type string, subtype string")


def when_active() -> Column:
    return F.coalesce("ended_at", "started_at")


def numbered_sessions(sessions: DataFrame, n: int | None = None) -> DataFrame:
    """Sessions with num, 1 for the most recent; ties by id.  n: only the first n (None or not above 0: all).

    A few are a top-n.  All are numbered by day: a rank within the day plus the
    sessions of later days, so no task sees more than a day's sessions.
    """
    if n is not None and n > 0:
        top = sessions.orderBy(F.desc(when_active()), "id").limit(n)
        return top.withColumn("num", F.row_number().over(Window.orderBy(F.desc(when_active()), "id")).cast("long"))
    rows = sessions.withColumn("__day", F.coalesce(F.floor(when_active() / DAY_MS), F.lit(-(2**62))))
    days = rows.groupBy("__day").agg(F.count("*").alias("__n"))
    later = days.select("__day", (F.sum("__n").over(Window.orderBy(F.desc("__day"))) - F.col("__n")).alias("__later"))
    own = F.row_number().over(Window.partitionBy("__day").orderBy(F.desc(when_active()), "id"))
    return rows.withColumn("__own", own).join(later, "__day").withColumn("num", (F.col("__own") + F.col("__later")).cast("long")).drop("__day", "__own", "__later")


def session_list(sessions: DataFrame) -> DataFrame:
    return numbered_sessions(sessions).select("id", "num", "source", "started_at", "ended_at", F.coalesce("project_path", F.lit("")).alias("project_path")).orderBy("num")


def tool_calls(events: DataFrame) -> DataFrame:
    return events.filter((F.col("event_type") == "tool_call") & F.col("tool_name").isNotNull())


def is_standard(name: Column) -> Column:
    return name.isin(STANDARD_TOOLS)


def tool_histogram(sessions: DataFrame, events: DataFrame, n: int | None = None) -> DataFrame:
    """tool_name, sess_no, cnt, total, is_standard for the n most recent sessions; standard tools first, then by name."""
    picked = numbered_sessions(sessions, n).select(F.col("id").alias("session_id"), F.col("num").alias("sess_no"))
    counts = tool_calls(events).select("session_id", "tool_name").join(picked, "session_id").groupBy("tool_name", "sess_no").agg(F.count("*").alias("cnt"))
    out = counts.withColumns({"total": F.sum("cnt").over(Window.partitionBy("tool_name")), "is_standard": is_standard(F.col("tool_name"))})
    return out.select("tool_name", "sess_no", "cnt", "total", "is_standard").orderBy(F.desc("is_standard"), "tool_name", "sess_no")


def tool_table(sessions: DataFrame, events: DataFrame, n: int) -> DataFrame:
    """tool_name, a column for each of the n most recent sessions (also those without calls), total."""
    long = tool_histogram(sessions, events, n)
    wide = long.groupBy("tool_name").pivot("sess_no", list(range(1, n + 1))).agg(F.first("cnt"))
    cells = [F.coalesce(F.col(str(i)), F.lit(0)).cast("long") for i in range(1, n + 1)]
    total = sum(cells[1:], cells[0]) if cells else F.lit(0).cast("long")
    return wide.select("tool_name", *(c.alias(f"s{i}") for i, c in enumerate(cells, 1)), total.alias("total")).orderBy(F.desc(is_standard(F.col("tool_name"))), "tool_name")


def tool_counts(events: DataFrame) -> DataFrame:
    return tool_calls(events).groupBy("tool_name").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "tool_name")


#: A session with a number up to this is found by a top-n; others by numbering all sessions.
MOST_SORTED = 10_000


def session_by_number(sessions: DataFrame, events: DataFrame, num: int) -> DataFrame:
    """Events of the session with this number, in order; none if there is no such session."""
    picked = numbered_sessions(sessions, num if num <= MOST_SORTED else None).filter(F.col("num") == num).select(F.col("id").alias("session_id"))
    return events.join(F.broadcast(picked), "session_id").orderBy(F.asc_nulls_first("timestamp"), "line_no", "block_pos")  # picked: one row


ALL_PARTS = ("prompt", "pr", "agent", "tool", "perm")


def transcript(session_events: DataFrame, parts: tuple[str, ...] = ALL_PARTS) -> DataFrame:
    """event_type, subtype, tool_name, rendered: what each shown event of a session prints, in order."""
    show = lambda *names: F.lit(any(p in parts for p in names))
    said = F.coalesce("content", F.lit(""))
    name = F.coalesce("tool_name", F.lit(""))
    field = lambda f: X.head(Tl.input_field(F.col("tool_input"), f), 80)
    agent = F.coalesce(Tl.is_agent(F.col("tool_name")), F.lit(False))
    kind, sub = F.col("event_type"), F.col("subtype")
    answer = X.normal_response(said)
    rendered = (
        F.when((kind == "user_message") & sub.isin("prompt", "slash_command") & show("prompt", "pr"), F.concat(F.lit("## User\n```\n"), X.normal_prompt(said), F.lit("\n```\n")))
        .when((kind == "user_message") & (sub == "tool_result") & show("tool"), F.concat(F.lit("[tool_result] "), name, F.lit("\n"), F.substring(said, 1, 500), F.lit("\n")))
        .when((kind == "user_message") & (sub == "permission_denied") & show("perm"), F.concat(F.lit("[permission_denied] "), name, F.lit("\n")))
        .when((kind == "assistant_message") & sub.isin("response", "truncated") & show("pr") & (answer != ""), F.concat(F.lit("## Model\n"), answer, F.lit("\n")))
        .when((kind == "tool_call") & agent & show("agent"), F.concat(F.lit("[agent] "), name, F.lit("\n  desc: "), field("description"), F.lit("\n  prompt: "), field("prompt"), F.lit("\n")))
        .when((kind == "tool_call") & ~agent & show("tool"), F.concat(F.lit("[tool] "), name, F.lit("\n"), F.coalesce(F.concat(F.lit("  "), F.substring("tool_input", 1, 120), F.lit("\n")), F.lit(""))))
    )
    return session_events.withColumn("rendered", rendered).filter(F.col("rendered").isNotNull()).select("event_type", "subtype", "tool_name", "rendered")


def permissions(events: DataFrame) -> DataFrame:
    return events.filter(F.col("subtype") == "permission_denied").select("session_id", "timestamp", F.coalesce("tool_name", F.lit("")).alias("tool_name")).orderBy(F.asc_nulls_first("timestamp"), "session_id")


def task_tools(counts: DataFrame) -> DataFrame:
    return counts.filter(Tl.is_task_name(F.col("tool_name")))


def web_tools(counts: DataFrame) -> DataFrame:
    return counts.filter(Tl.is_web(F.col("tool_name")))


def task_invocations(events: DataFrame) -> DataFrame:
    calls = tool_calls(events).filter(Tl.is_task_like(F.col("tool_name")))
    field = lambda f: F.coalesce(Tl.input_field(F.col("tool_input"), f), F.lit(""))
    cut = lambda c: F.concat(F.substring(c, 1, 80), F.when(F.length(c) > 80, X.ELLIPSIS).otherwise(""))
    return calls.orderBy(F.asc_nulls_first("timestamp"), "line_no", "block_pos").select("session_id", "event_id", "tool_name", "timestamp", cut(field("description")).alias("description"), cut(field("prompt")).alias("prompt"), field("subagent_type").alias("subagent"))


def task_outcomes(events: DataFrame) -> DataFrame:
    results = events.filter((F.col("event_type") == "user_message") & (F.col("subtype") == "tool_result") & Tl.is_task_like(F.col("tool_name")))
    return results.groupBy(X.outcome(F.col("content")).alias("outcome")).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "outcome")


def task_review(events: DataFrame) -> dict[str, DataFrame]:
    counts = tool_counts(events)
    return {"tools": counts, "task": task_tools(counts), "web": web_tools(counts), "invocations": task_invocations(events), "outcomes": task_outcomes(events)}
