"""What ends a stream or a decision: blocked bodies, terminals, log rows, strikes, tickets and parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import let
from . import traffic
from .audit import Policy, danger_reason
from .toolcalls import blocked_call, tool_calls

#: The name of a model that is not known, and consecutive errors that disable a rule.
UNKNOWN_MODEL = "unknown_model"
STRIKES = 3


def blocked_body(protocol: Column, reason: Column, conversation: Column, model: Column, created: Column) -> Column:
    """A complete answer that says what was blocked, in the shape of the protocol; null for any other."""
    text = F.concat(F.lit("[blocked: "), reason, F.lit("]"))
    named = F.coalesce(F.when(model != "", model), F.lit(UNKNOWN_MODEL)).alias("model")
    conv = F.coalesce(conversation, F.lit(""))
    message = F.struct(F.lit("assistant").alias("role"), text.alias("content"))
    chat = F.struct(
        F.when(conv == "", "blocked-unknown").otherwise(F.concat(F.lit("blocked-"), conv)).alias("id"), F.lit("chat.completion").alias("object"), created.alias("created"), named,
        F.array(F.struct(F.lit(0).alias("index"), F.lit("stop").alias("finish_reason"), message.alias("message"))).alias("choices"),
        F.struct(F.lit(0).alias("prompt_tokens"), F.lit(1).alias("completion_tokens"), F.lit(1).alias("total_tokens")).alias("usage"),
    )
    own = F.when(conv == "", "blocked-0").otherwise(conv).alias("id")
    messages = F.struct(
        own, F.lit("message").alias("type"), F.lit("assistant").alias("role"), named, F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content"),
        F.lit("end_turn").alias("stop_reason"), F.struct(F.lit(0).alias("input_tokens"), F.lit(1).alias("output_tokens")).alias("usage"),
    )
    response = F.struct(
        own, F.lit("response").alias("object"), created.alias("created_at"), named, F.lit("failed").alias("status"), F.expr("cast(array() as array<string>)").alias("output"),
        F.struct(F.lit("blocked").alias("code"), text.alias("message")).alias("error"),
    )
    return F.when(protocol == "chat", F.to_json(chat)).when(protocol == "anthropic", F.to_json(messages)).when(protocol == "responses", F.to_json(response))


def audited_body(body: Column, protocol: Column, created: Column, mode: str = "block", policy: Policy = Policy(), approvers: tuple[str, ...] = ()) -> Column:
    """(body, reason, index) of a whole answer: its first dangerous call takes its place by a body that says so.

    With approvers, or with the mode off, a body stays; the reason of a call that waits is given all the same.
    """
    found = F.when(F.lit(mode != "off"), blocked_call(tool_calls(body), lambda name, args: danger_reason(name, args, policy)))
    stops = mode == "block" or (mode == "approve" and not approvers)

    def made(first: Column) -> Column:
        new = blocked_body(protocol, first["reason"], traffic.conversation_id(body), traffic.stream_model(body), created)
        return F.struct(F.when(first["reason"].isNotNull() & F.lit(stops), F.coalesce(new, body)).otherwise(body).alias("body"), first["reason"].alias("reason"), first["index"].alias("index"))

    return let(found, made)


def control_action(terminal_sent: Column, failed_sent: Column, is_error: Column, is_failed: Column) -> Column:
    """What becomes of a control event of a response stream."""
    return F.when(terminal_sent, "ignore").when(is_error, "synthesize_failed").when(is_failed & failed_sent, "duplicate_failed").otherwise("pass")


def sticky_drop(rejected: Column, empty: Column, done: Column, terminal: Column, tool: Column) -> Column:
    """After a rejection empty, done, terminal and tool frames go."""
    return rejected & (empty | done | terminal | tool)


def terminal_due(protocol: Column, terminal_sent: Column, blocked: Column, any_sent: Column, truncated: Column) -> Column:
    """Whether a stream that broke off needs a terminal of ours."""
    return ~terminal_sent & ~blocked & (any_sent | truncated) & ((protocol != "responses") | any_sent)


def buffered(held: Column, tool: Column, complete: Column, index_complete: Column) -> Column:
    return held & tool & ~complete & ~index_complete


def with_terminals(frames: DataFrame) -> DataFrame:
    """Frames (stream, seq, terminal) with exactly one terminal a stream: the first of its own, or one of ours after its end."""
    first = F.min(F.when(F.col("terminal"), F.col("seq"))).over(Window.partitionBy("stream"))
    own = frames.withColumn("_first", first).filter(~F.col("terminal") | (F.col("seq") == F.col("_first"))).select("stream", "seq", "terminal", F.lit(False).alias("synthetic"))
    missing = frames.groupBy("stream").agg(F.max("seq").alias("last"), F.max("terminal").alias("had")).filter("not had")
    return own.unionByName(missing.select("stream", (F.col("last") + 1).alias("seq"), F.lit(True).alias("terminal"), F.lit(True).alias("synthetic")))


def stream_rows(events: DataFrame) -> DataFrame:
    """One log row a stream (stream, ts_secs, status, finished): one that never finished was left by its client.

    Such a row has no status, and its latency counts whole seconds only.
    """
    done = F.max("finished")
    return events.groupBy("stream").agg(
        F.min("ts_secs").alias("started"), ((F.max("ts_secs") - F.min("ts_secs")) * 1000).alias("latency_ms"), F.when(done, F.max(F.when(F.col("finished"), F.col("status")))).alias("status"),
        F.when(~done, "client_aborted").alias("error_kind"), F.count("*").alias("events"),
    )


def by_slot(frames: DataFrame) -> DataFrame:
    """Frames (stream, slot, seq) in the order in which they leave: slot by slot, as slots were opened, numbered from 0."""
    opened = frames.withColumn("_opened", F.min("seq").over(Window.partitionBy("stream", "slot")))
    place = F.row_number().over(Window.partitionBy("stream").orderBy("_opened", "slot", "seq")) - 1
    return opened.select("stream", "slot", "seq", place.cast("bigint").alias("place"))


def disabled_rules(runs: DataFrame, strikes: int = STRIKES) -> DataFrame:
    """When each rule (rule, seq, failed) was disabled: at its first run of consecutive errors."""
    order = Window.partitionBy("rule").orderBy("seq")
    recent = order.rowsBetween(1 - strikes, 0)
    struck = (F.sum(F.col("failed").cast("int")).over(recent) == strikes) & (F.count("*").over(recent) == strikes)
    return runs.withColumn("_s", struck).filter("_s").groupBy("rule").agg(F.min("seq").alias("disabled_at"))


def first_blocks(judged: DataFrame) -> DataFrame:
    """The first call of each body (body, pos, reason) that has a reason."""
    return judged.filter("reason is not null").groupBy("body").agg(F.min_by("reason", "pos").alias("reason"), F.min("pos").alias("pos"), F.count("*").alias("blocking"))


def audit_rows(judged: DataFrame, summary: Column, mode: str) -> DataFrame:
    """Rows for the audit log; nothing is recorded while the mode is off."""
    kind = F.when(F.col("verdict") == "need_approval", "approval").otherwise(F.col("verdict"))
    return judged.filter(F.lit(mode != "off")).select("id", kind.alias("kind"), summary.alias("summary"), "reason")


def ticket(reason: Column, caller: Column, entry: Column, field: Column) -> Column:
    """The text of an approval ticket, a line for each fact that is known."""
    line = lambda name, value: F.when(value != "", F.concat(F.lit(name + ": "), value))
    return F.concat_ws("\n", line("reason", reason), line("caller", caller), line("entry", entry), line("field", field))


def merged_parameters(body: Column, defaults: Column, overrides: Column, dropped: Column) -> Column:
    """A map of parameters: defaults, then the body's own, then overrides; dropped names go last of all."""
    known = F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(body, k) & ~F.map_contains_key(overrides, k)), F.map_filter(body, lambda k, v: ~F.map_contains_key(overrides, k)), overrides)
    return F.map_filter(known, lambda k, v: ~F.array_contains(dropped, k))


def open_decisions(asked: DataFrame, ttl: int) -> DataFrame:
    """Requests (key, ts_secs, id) with whether an earlier one of the key, no older than ``ttl``, still decides."""
    last = F.lag("ts_secs").over(Window.partitionBy("key").orderBy("ts_secs", "id"))
    return asked.select("key", "id", "ts_secs", F.coalesce(F.col("ts_secs") - last <= ttl, F.lit(False)).alias("open"))


def unexpired(hits: DataFrame, now: int, window: int) -> DataFrame:
    """Keys whose last hit still counts."""
    return hits.groupBy("key").agg(F.max("ts_secs").alias("last_ts")).filter(F.col("last_ts") > now - window)


def event_frame(event: Column, data: Column) -> Column:
    """A server-sent event as text: a line for each line of the data, and a blank one at the end."""
    lines = F.transform(F.split(F.regexp_replace(data, r"\r\n|\r", "\n"), "\n", -1), lambda x: F.concat(F.lit("data: "), x))
    return F.concat(F.when(event != "", F.concat(F.lit("event: "), event, F.lit("\n"))).otherwise(""), F.array_join(lines, "\n"), F.lit("\n\n"))
