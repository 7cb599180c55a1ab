"""Payloads of model traffic: token usage, tool calls, finish reasons, event streams."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def may_differ(body: Column) -> Column:
    """Whether a JSON text may write its names and words in another way than plainly between double quotes."""
    return body.contains("\\u") | body.contains("'")


def member(body: Column, path: str) -> Column:
    """What stands at a path; a text without the path's last name is not parsed for it."""
    name = re.findall(r"\.(\w+)", path)[-1]
    return F.when(body.contains(f'"{name}"') | may_differ(body), F.get_json_object(body, path))


def _number(body: Column, *paths: str) -> Column:
    return F.coalesce(*[member(body, p).try_cast("bigint") for p in paths])


def usage(body: Column) -> Column:
    """Token counts of a response or of a stream event, whichever field names it uses."""
    roots = ("$.usage", "$.message.usage", "$.response.usage")
    at = lambda *names: _number(body, *[f"{r}.{n}" for r in roots for n in names])
    prompt, completion, total = at("prompt_tokens", "input_tokens"), at("completion_tokens", "output_tokens"), at("total_tokens")
    return F.when(
        F.coalesce(prompt, completion, total).isNotNull(),
        F.struct(
            F.coalesce(prompt, F.lit(0)).alias("prompt"), F.coalesce(completion, F.lit(0)).alias("completion"), total.alias("total"),
            F.coalesce(at("prompt_tokens_details.cached_tokens", "input_tokens_details.cached_tokens", "cache_read_input_tokens"), F.lit(0)).alias("cached_read"),
            F.coalesce(at("cache_creation_input_tokens"), F.lit(0)).alias("cached_write"),
        ),
    )


def merge_usage(events: DataFrame, key: str, usage_column: str = "usage") -> DataFrame:
    """Per stream the greatest of each count; the total is explicit if an event gave one, else the sum."""
    u = lambda n: F.max(F.col(f"{usage_column}.{n}"))
    total = F.coalesce(u("total"), u("prompt") + u("completion"))
    return events.filter(F.col(usage_column).isNotNull()).groupBy(key).agg(
        u("prompt").alias("prompt"), u("completion").alias("completion"), total.alias("total"), u("cached_read").alias("cached_read"), u("cached_write").alias("cached_write")
    )


def conversation_id(body: Column) -> Column:
    """First identifier that the payload offers."""
    paths = ("$.id", "$.response.id", "$.data.id", "$.data.response.id", "$.message.id", "$.error.id")
    return F.coalesce(*[F.nullif(member(body, p), F.lit("")) for p in paths])


def archived_id(body: Column) -> Column:
    return F.concat(F.lit("unknown_"), F.substring(F.sha2(body, 256), 1, 8))


def finish_reason(body: Column) -> Column:
    return F.coalesce(*[member(body, p) for p in ("$.choices[0].finish_reason", "$.choices[1].finish_reason", "$.delta.stop_reason", "$.stop_reason", "$.response.status", "$.status")])


def stream_model(body: Column) -> Column:
    return F.coalesce(*[member(body, p) for p in ("$.model", "$.message.model", "$.response.model")])


def protocol_of(path: Column) -> Column:
    """Protocol of a request path; the query part and capitals do not count."""
    tail = F.regexp_replace(F.lower(F.substring_index(path, "?", 1)), r"/+$", "")
    return (
        F.when(tail.rlike(r"/chat/completions(?:/[^/]+)?$"), "chat")
        .when(tail.rlike(r"/messages/count_tokens$"), "anthropic")
        .when(tail.rlike(r"/messages(?:/(?!batches)[^/]+)?$"), "anthropic")
        .when(tail.rlike(r"/responses(?:/(?!compact|input_items)[^/]+)?$"), "responses")
        .otherwise("passthrough")
    )


def body_class(is_chat: Column, length: Column, is_json: Column, status: Column) -> Column:
    return F.when(~is_chat, "non_dialog_exempt").when(status >= 400, "passthrough_error_status").when((length == 0) | ~is_json, "non_stream_to_502").otherwise("passthrough_ok")


def carries_output(body: Column) -> Column:
    """Whether a stream event holds text for the reader, and not only bookkeeping."""
    text = [F.length(member(body, p)) > 0 for p in ("$.choices[0].delta.content", "$.choices[0].delta.reasoning_content", "$.delta.text", "$.delta.thinking")]
    out = member(body, "$.type").isin("response.output_text.delta", "response.reasoning_text.delta", "response.refusal.delta")
    for t in text:
        out = F.coalesce(out, F.lit(False)) | F.coalesce(t, F.lit(False))
    return F.coalesce(out, F.lit(False))


def first_token(events: DataFrame, key: str, at: str, started: str, body: str = "data") -> DataFrame:
    """Milliseconds from a stream's start to its first event with text."""
    first = F.min(F.when(carries_output(F.col(body)), F.col(at)))
    return events.groupBy(key).agg((first - F.min(started)).alias("ttft_ms"), F.count("*").alias("events"))


def sse_events(chunks: DataFrame, key: str, seq: str, chunk: str) -> DataFrame:
    """Server-sent events of complete streams: (key, pos, event, data, id).

    Chunks of a stream are joined in order, so it must fit one task; streams are bounded by the
    service's own limit.  Line ends of all three kinds count; comments are dropped; several data
    lines are joined by line feeds; an event without data and name is none.
    """
    whole = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(chunk).alias("c")))).alias("cs"))
    text = F.regexp_replace(F.array_join(F.transform("cs", lambda x: x["c"]), ""), r"^\ufeff", "")
    blocks = F.split(F.regexp_replace(text, r"\r\n|\r", "\n"), "\n\n+", -1)
    each = whole.select(key, F.posexplode(blocks).alias("pos", "block")).withColumn("lines", F.split("block", "\n", -1))

    def field(name: str) -> Column:
        own = F.filter("lines", lambda x: x.startswith(name + ":") | (x == name))
        return F.transform(own, lambda x: F.regexp_replace(F.substring(x, len(name) + 2, 1 << 30), "^ ", ""))

    fields = each.select(key, F.col("pos").cast("long").alias("pos"), F.element_at(F.concat(F.array(F.lit(None).cast("string")), field("event")), -1).alias("event"),
                         field("data").alias("d"), F.element_at(F.concat(F.array(F.lit(None).cast("string")), field("id")), -1).alias("id"))
    return fields.filter((F.size("d") > 0) | F.col("event").isNotNull()).select(key, "pos", "event", F.array_join("d", "\n").alias("data"), "id")
