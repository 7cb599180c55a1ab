"""Rows for logs and pages, life spans of approvals and executions, and frames that announce a block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bodies import is_json
from ..functions.scan import let, scan
from .secrets import for_log

#: Longest logged output, longest summary, hints of a dictionary, and bounds of what is held of a stream.
OUTPUT_LENGTH, SUMMARY_LENGTH, HINTS = 2_048, 512, 64
HELD_FRAMES, HELD_BYTES = 4_096, 8 << 20
#: Seconds that an approval waits by branch, and parts of an execution's life.
WAITS = {"credential": 300, "command": 600}
WAIT, EXECUTION_WAIT, EXECUTION_SLACK, EXECUTION_DONE = 60, 600, 60, 300
#: Events that close a tool call, and that end a stream.
CLOSING = ("content_block_stop", "response.function_call_arguments.done", "response.custom_tool_call_input.done", "response.output_item.done")
TERMINAL = ("message_stop", "response.completed", "response.failed", "response.incomplete", "[DONE]")
SPAN = "struct<text:string,start:int,end:int>"


def logged_commands(log: DataFrame) -> DataFrame:
    """Command rows as they are kept: parameters and output for the log, and short."""
    return log.withColumns({c: F.substring(for_log(F.col(c)), 1, OUTPUT_LENGTH) for c in ("params_json", "stdout", "stderr")})


def log_lines(rows: DataFrame) -> DataFrame:
    """Each row as one JSON line for the audit log, with every text in it made fit to keep."""
    fit = [for_log(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in rows.schema.fields]
    return rows.select(F.to_json(F.struct(*fit)).alias("line"))


def prefix_hints(names: DataFrame, column: str, n: int = HINTS) -> DataFrame:
    """The longest distinct names, by text where they are of one length."""
    return names.select(F.col(column).alias("name")).filter("name <> ''").distinct().orderBy(F.desc(F.length("name")), "name").limit(n)


def prompt_summary(model: Column, sampling: Column, contents: Column) -> Column:
    """What a request asked, for the log: the model, its sampling map and the texts one after the other."""
    keys = F.transform(F.array_sort(F.map_entries(sampling)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.substring(for_log(F.concat_ws(" ", F.concat(F.lit("model="), model), F.array_join(keys, " "), F.array_join(contents, " "))), 1, SUMMARY_LENGTH)


def restored_spans(text: Column, known: Column, token: str) -> Column:
    """(restored text, its restored stretches) of a text with placeholders; unknown ones stay and are none."""
    found = F.regexp_extract_all(text, F.lit(token), F.lit(0))
    pieces = F.arrays_zip(F.split(text, token, -1).alias("before"), F.transform(found, lambda t: F.struct(t.alias("t"), F.try_element_at(known, t).alias("v"))).alias("hit"))

    def step(pos: Column, p: Column) -> tuple[Column, Column]:
        start = pos + F.length(p["before"])
        value = F.coalesce(p["hit"]["v"], p["hit"]["t"], F.lit(""))
        span = F.struct(value.alias("text"), start.alias("start"), (start + F.length(value)).alias("end"))
        return start + F.length(value), F.when(p["hit"]["v"].isNotNull(), F.array(span)).otherwise(F.from_json(F.lit("[]"), f"array<{SPAN}>"))

    def both(ps: Column) -> Column:
        whole = F.array_join(F.transform(ps, lambda p: F.concat(p["before"], F.coalesce(p["hit"]["v"], p["hit"]["t"], F.lit("")))), "")
        return F.struct(whole.alias("text"), scan(ps, F.lit(0), step, SPAN).alias("spans"))

    return let(pieces, both)


def entry_properties(title: Column, username: Column, password: Column, url: Column, custom: Column) -> Column:
    """An entry's properties as one map: its own after the fixed ones; the password only as a token."""
    fixed = F.map_filter(F.create_map(F.lit("title"), title, F.lit("username"), username, F.lit("password"), password, F.lit("url"), url), lambda k, v: v != "")
    return F.map_concat(fixed, F.map_filter(custom, lambda k, v: ~k.isin("title", "username", "password", "url")))


def event_class(kind: Column) -> Column:
    """terminal, closing, tool, text, control or other, by the type of a stream event."""
    return (
        F.when(kind.isin(*TERMINAL), "terminal").when(kind.isin(*CLOSING), "closing").when(kind.rlike("function_call|tool_call|_call_"), "tool")
        .when(kind.rlike(r"output_text|refusal|text_delta|reasoning"), "text").when(kind.isin("ping", "error", "response.created", "message_start"), "control").otherwise("other")
    )


def held_until(frames: DataFrame, most_frames: int = HELD_FRAMES, most_bytes: int = HELD_BYTES) -> DataFrame:
    """Per stream (stream, seq, size) the frame at which holding gives up, null if it never does."""
    order = Window.partitionBy("stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    over = (F.count("*").over(order) > most_frames) | (F.sum("size").over(order) > most_bytes)
    return frames.withColumn("_over", over).groupBy("stream").agg(F.min(F.when(F.col("_over"), F.col("seq"))).alias("rejected_at"), F.sum("size").alias("bytes"))


def block_frames(protocol: Column, reason: Column, conversation: Column, cursor: Column) -> Column:
    """(event, data) frames that tell a reader of the stream what was blocked; numbered on from the cursor."""
    text = F.concat(F.lit("[blocked: "), reason, F.lit("]"))
    frame = lambda event, *fields: F.struct(F.lit(event).alias("event"), F.to_json(F.struct(F.lit(event).alias("type"), *fields)).alias("data"))
    own = conversation.alias("id")
    chunk = lambda delta, finish: F.struct(
        F.lit("").alias("event"), F.to_json(F.struct(own, F.array(F.struct(F.lit(0).alias("index"), delta.alias("delta"), F.lit(finish).cast("string").alias("finish_reason"))).alias("choices"))).alias("data")
    )
    chat = F.array(
        chunk(F.struct(F.lit("assistant").alias("role"), text.alias("content")), None), chunk(F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("content")), "stop"),
        F.struct(F.lit("").alias("event"), F.lit("[DONE]").alias("data")),
    )
    messages = F.array(
        frame("message_start", own), frame("content_block_start", F.lit(0).alias("index")), frame("content_block_delta", F.lit(0).alias("index"), text.alias("text")),
        frame("content_block_stop", F.lit(0).alias("index")), frame("message_stop"),
    )
    base = F.coalesce(cursor + 1, F.lit(0).cast("bigint"))
    number = lambda k: (base + k).alias("sequence_number")
    names = ("response.created", "response.output_item.added", "response.output_text.delta", "response.output_text.done", "response.output_item.done", "response.completed")
    responses = F.array(*[frame(name, number(k), text.alias("text")) for k, name in enumerate(names)])
    return F.when(protocol == "chat", chat).when(protocol == "anthropic", messages).when(protocol == "responses", responses).otherwise(F.from_json(F.lit("[]"), "array<struct<event:string,data:string>>"))


def residue(tail: Column) -> Column:
    """What is kept of a stream's unfinished end: a whole JSON object or array, after an optional ``data:``; else null."""
    bare = F.trim(F.regexp_replace(tail, r"^\s*data:", ""))
    return F.when(bare.rlike(r"^[\[{]") & is_json(bare), bare)


def expired_approvals(open_: DataFrame, now: int) -> DataFrame:
    """Approvals (id, branch, created) whose time is over, by branch."""
    wait = F.coalesce(*[F.when(F.col("branch") == b, s) for b, s in WAITS.items()], F.lit(WAIT))
    return open_.filter(F.col("created") + wait < now).select("id", "branch", (F.col("created") + wait).alias("ended"))


def execution_ends(state: Column, since: Column, timeout: Column) -> Column:
    """When the record of an execution goes: a pending one lives as long as its command may wait and run."""
    return since + F.when(state == "pending", F.lit(EXECUTION_WAIT) + timeout + EXECUTION_SLACK).otherwise(EXECUTION_DONE)


def registration_result(decision: Column, revoked: Column, now: int) -> Column:
    """(enabled, revoked, mode, authorized_at) after the decision on a registration.

    Nothing enables a caller that was revoked meanwhile; a rejection or no answer revokes.
    """
    yes = decision.isin("approve", "approve_always") & ~revoked
    return F.struct(
        yes.alias("enabled"), (revoked | ~decision.isin("approve", "approve_always")).alias("revoked"), F.when(yes & (decision == "approve_always"), "allow").alias("mode"), F.when(yes, F.lit(now)).alias("authorized_at")
    )


def revocation_result(decision: Column, emergency: Column) -> Column:
    """Whether a caller is revoked: at once in an emergency, else when it is approved."""
    return emergency | F.coalesce(decision == "approve", F.lit(False))


def page_payload(**parts: Column) -> Column:
    """The parts of a page as one JSON object."""
    return F.to_json(F.struct(*[value.alias(name) for name, value in parts.items()]))
