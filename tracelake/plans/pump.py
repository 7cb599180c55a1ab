"""Answer streams made of the turns of conversations, in three protocols, and what becomes of them.

A turn's first word is a placeholder in its stream, so it is cut by frames at any place; each stream
asks for one tool call, dangerous ones among them, and some break off within it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonspan
from ..functions.scan import let
from ..operators import pump
from ..sources.driver_tables import table
from ..sources.shared import checkpointed

NOTE = 'keep __PII_ "tokens"'
_SCALE = 1_700_000_000_000


def turns(s, d):
    """One row a turn, its protocol by its length."""
    rows = table(s, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    named = rows.withColumn("n", F.length("text").cast("long")).withColumn("word", F.regexp_extract("text", r"^\S+", 0))
    protocol = F.element_at(F.array(*[F.lit(p) for p in ("chat", "anthropic", "responses")]), (F.col("n") % 3 + 1).cast("int"))
    return named.select("*", F.concat_ws("-", "conv_id", "turn", "role").alias("stream"), protocol.alias("protocol"), (F.col("n") % 5 == 0).alias("danger"), (F.col("n") % 7 == 3).alias("cut"))


def frames(s, d):
    """Frames (see ``operators.pump``) of all turns."""
    rows = turns(s, d)
    token = F.concat(F.lit("__PII_"), "turn", F.lit("_"), F.substring(F.md5("text"), 1, 8), F.lit("__"))
    size = (F.col("n") % 23 + 7).cast("int")
    pieces = lambda text: F.when(text == "", F.expr("cast(array() as array<string>)")).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int")), lambda k: F.substring(text, k * size + 1, size))
    )
    hidden = F.when(F.col("word") != "", F.replace("text", "word", "token")).otherwise(F.col("text"))
    # Dealt out, as a turn has some tens of frames; what is made before is not made again for each of them.
    parts = max(int(s.conf.get("spark.sql.shuffle.partitions")), 2 * s.sparkContext.defaultParallelism)
    rows = rows.withColumn("token", token).withColumn("pieces", let(hidden, pieces)).drop("text").repartition(parts, "stream")
    pieces = F.col("pieces")
    command = F.concat(F.when(F.col("danger"), "rm -rf ").otherwise("ls "), F.lower(F.regexp_replace("word", "[^A-Za-z]", "")), F.lit("x"))
    args = F.concat(F.lit('{"command":"'), command, F.lit('"}'))
    parts = [F.substring(args, 1, 17), F.substring(args, 18, 1 << 20)]
    j = lambda *fields: F.to_json(F.struct(*fields))
    one = lambda **fields: F.struct(*[v.alias(k) for k, v in fields.items()])
    text = F.lit
    model, own = F.concat(F.lit("model-"), "role").alias("model"), F.col("stream").alias("id")

    def chunk(delta, finish=None):
        return one(event=text(""), data=j(own, model, F.array(one(index=F.lit(0), delta=delta, finish_reason=text(finish).cast("string"))).alias("choices")))

    def tool(**fields):
        return one(tool_calls=F.array(one(index=F.lit(0), **fields)))

    def event(kind, *fields):
        return one(event=text(kind), data=j(text(kind).alias("type"), *fields))

    usage = one(prompt_tokens=F.col("n"), completion_tokens=F.col("n") + 1).alias("usage")
    chat = F.concat(
        F.transform(pieces, lambda p: chunk(one(content=p))),
        F.array(chunk(tool(id=text("call-1"), function=one(name=text("bash"), arguments=parts[0]))), chunk(tool(function=one(arguments=parts[1])))),
        F.when(F.col("cut"), F.expr("cast(array() as array<struct<event:string,data:string>>)")).otherwise(
            F.array(chunk(one(content=text(None).cast("string")), "tool_calls"), one(event=text(""), data=j(own, model, F.expr("cast(array() as array<string>)").alias("choices"), usage)), one(event=text(""), data=text("[DONE]")))
        ),
    )
    at = lambda n: F.lit(n).alias("index")
    messages = F.concat(
        F.array(event("message_start", one(id=F.col("stream"), model=F.concat(F.lit("model-"), "role"), usage=one(input_tokens=F.col("n"))).alias("message")), event("content_block_start", at(0), one(type=text("text"), text=text("")).alias("content_block"))),
        F.transform(pieces, lambda p: event("content_block_delta", at(0), one(type=text("text_delta"), text=p).alias("delta"))),
        F.array(
            event("content_block_stop", at(0)), event("content_block_start", at(1), one(type=text("tool_use"), id=text("call-1"), name=text("bash")).alias("content_block")),
            *[event("content_block_delta", at(1), one(type=text("input_json_delta"), partial_json=p).alias("delta")) for p in parts],
        ),
        F.when(F.col("cut"), F.expr("cast(array() as array<struct<event:string,data:string>>)")).otherwise(
            F.array(event("content_block_stop", at(1)), event("message_delta", one(stop_reason=text("tool_use")).alias("delta"), one(output_tokens=F.col("n") + 1).alias("usage")), event("message_stop"))
        ),
    )
    said = F.size(pieces)
    number = lambda n: F.lit(n).alias("sequence_number") if isinstance(n, int) else n.alias("sequence_number")
    out, item = F.lit(1).alias("output_index"), text("item-1").alias("item_id")
    responses = F.concat(
        F.array(event("response.created", number(0), one(id=F.col("stream"), model=F.concat(F.lit("model-"), "role")).alias("response"))),
        F.transform(pieces, lambda p, k: event("response.output_text.delta", number(k + 1), text("item-0").alias("item_id"), F.lit(0).alias("output_index"), p.alias("delta"))),
        F.array(
            event("response.output_item.added", number(said + 1), out, one(type=text("function_call"), id=text("item-1"), name=text("bash")).alias("item")),
            *[event("response.function_call_arguments.delta", number(said + 2 + k), item, out, p.alias("delta")) for k, p in enumerate(parts)],
        ),
        F.when(F.col("cut"), F.expr("cast(array() as array<struct<event:string,data:string>>)")).otherwise(
            F.array(
                event("response.function_call_arguments.done", number(said + 4), item, out, args.alias("arguments")),
                event("response.completed", number(said + 5), one(id=F.col("stream"), status=text("completed"), usage=one(input_tokens=F.col("n"), output_tokens=F.col("n") + 1)).alias("response")),
            )
        ),
    )
    built = F.when(F.col("protocol") == "chat", chat).when(F.col("protocol") == "anthropic", messages).otherwise(responses)
    closed = F.concat(built, F.array(one(event=F.when(F.col("cut"), "broken"), data=text(None).cast("string"))))
    known = F.when(F.col("word") != "", F.to_json(F.create_map("token", "word")))
    each = rows.select("stream", "protocol", known.alias("known"), F.posexplode(closed).alias("seq", "f"))
    return each.select(
        "stream", F.col("seq").cast("long").alias("seq"), (F.lit(_SCALE) + F.col("seq") * 10).alias("at"), "protocol", "f.event", "f.data",
        F.when(F.col("seq") == 0, F.col("known")).alias("known"), F.col("f.data").isNull().alias("ended"),
    )


def _sent(s, d):
    """The log row of each stream with the text that it sent and the number of its ends."""
    rows = checkpointed(pump.pump(frames(s, d)))  # read twice
    sent = pump.written_out(rows)
    at = lambda path: F.get_json_object("data", path)
    said = F.coalesce(F.when(~at("$.choices[0].delta.content").startswith("[blocked: "), at("$.choices[0].delta.content")), at("$.delta.text"), F.when(at("$.type") == "response.output_text.delta", at("$.delta")))
    ends = (F.col("data") == "[DONE]") | F.coalesce(at("$.type").isin("message_stop", "response.completed", "response.failed"), F.lit(False))
    texts = sent.groupBy("stream").agg(
        F.sum(ends.cast("long")).alias("ends"), F.array_sort(F.collect_list(F.when(said.isNotNull(), F.struct("place", "part", said.alias("t"))))).alias("ts")
    )
    text = F.sha2(F.array_join(F.transform("ts", lambda x: x["t"]), ""), 256)
    logs = pump.stream_logs(rows).select("stream", "protocol", "model", "finish", "terminal", "truncated", "rejected", "dropped", "prompt", "completion", "total")
    return logs.join(texts.select(F.col("stream").alias("of"), "ends", text.alias("text")), F.col("stream") == F.col("of")).drop("of")


def _bodies(s, d):
    """Requests of all turns, with names that lie at the wrong places, and their edits."""
    rows = turns(s, d)
    quote = F.to_json(F.struct(F.col("text").alias("t"), F.col("role").alias("r")))
    own = F.regexp_extract(quote, r'(?s)^\{"t":(".*"),"r":"[^"]*"\}$', 1)
    odd = '{"stream_options":{},"messages":[],"system":1,"input":{}}'
    body = (
        F.when(F.col("protocol") == "chat", F.concat(F.lit('{"model":"m","meta":' + odd + ',"stream" : true,"temperature":1.50,"messages":[{"role":"'), "role", F.lit('","content":'), own, F.lit("}]}")))
        .when(F.col("protocol") == "anthropic", F.concat(F.lit('{"meta":' + odd + ',"stream":true,"top_p":1e0,"system":'), own, F.lit(',"max_tokens":1.0}')))
        .otherwise(F.concat(F.lit('{"meta":' + odd + ',"input":[{"role":"user","content":'), own, F.lit('}],"instructions":"",  "seed":7}')))
    )
    made = rows.select("stream", "protocol", jsonspan.with_edits_twice(body, F.col("protocol"), F.lit(NOTE)).alias("e"))
    return made.select("stream", "protocol", "e.body", (F.col("e.body") == F.col("e.again")).alias("once"), F.col("e.same").alias("same"))


def _summaries(s, d):
    body = F.to_json(F.struct(F.col("role").alias("model"), F.lit("hidden").alias("user"), F.col("n").alias("seed"), F.array(F.struct(F.col("role"), F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("content"))).alias("messages")))
    made = turns(s, d).select("stream", jsonspan.request_summary(body).alias("j"))
    at = lambda path: F.get_json_object("j", path)
    return made.select("stream", at("$.model").alias("model"), at("$.seed").cast("long").alias("seed"), F.sha2(F.coalesce(at("$.text"), F.lit("")), 256).alias("text"), at("$.user").alias("hidden"))


QUERIES = {"pumped_streams": _sent, "edited_bodies": _bodies, "request_summaries": _summaries}
_TURNS = """WITH t AS (SELECT concat_ws('-', conv_id, turn, role) AS stream, role, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations),
  turns AS (SELECT *, list_extract(['chat', 'anthropic', 'responses'], n % 3 + 1) AS protocol, n % 5 = 0 AS danger, n % 7 = 3 AS cut FROM t)"""
_NOTE_SQL, _ODD_SQL = """'"keep __PII_ \\"tokens\\""'""", '{"stream_options":{},"messages":[],"system":1,"input":{}}'
_NOTED = """substr(to_json(text)::VARCHAR, 1, length(to_json(text)::VARCHAR) - 1) || CASE WHEN text = '' THEN '' ELSE '\\n\\n' END || 'keep __PII_ \\"tokens\\""'"""
ORACLE_SQL = {
    "pumped_streams": f"""{_TURNS} SELECT stream, protocol, 'model-' || role AS model,
        CASE WHEN NOT cut THEN CASE protocol WHEN 'chat' THEN 'tool_calls' WHEN 'anthropic' THEN 'tool_use' ELSE 'completed' END END AS finish,
        CASE WHEN danger THEN 'blocked' WHEN NOT cut THEN 'upstream' WHEN protocol = 'anthropic' THEN 'open' ELSE 'synthesized' END AS terminal,
        CASE WHEN cut AND NOT danger THEN CASE protocol WHEN 'responses' THEN 'synthesized_failed' ELSE 'open_ended' END END AS truncated,
        CASE WHEN danger THEN 'audit-policy-block' END AS rejected, CASE WHEN cut AND NOT danger THEN CASE protocol WHEN 'chat' THEN 2 ELSE 3 END ELSE 0 END AS dropped,
        CASE WHEN NOT cut OR protocol = 'anthropic' THEN n END AS prompt, CASE WHEN NOT cut THEN n + 1 WHEN protocol = 'anthropic' THEN 0 END AS completion,
        CASE WHEN NOT cut THEN 2 * n + 1 WHEN protocol = 'anthropic' THEN n END AS total,
        CASE WHEN cut AND NOT danger AND protocol = 'anthropic' THEN 0 ELSE 1 END AS ends, sha256(text) AS text FROM turns""",
    "edited_bodies": f"""{_TURNS}, m AS (SELECT *, '{{"role":"system","content":' || {_NOTE_SQL} || '}}' AS message FROM turns)
      SELECT stream, protocol, CASE protocol
        WHEN 'chat' THEN '{{"model":"m","meta":{_ODD_SQL},"stream" : true,"temperature":1.50,"messages":[' || CASE WHEN role = 'system' THEN '{{"role":"system","content":' || {_NOTED} || '}}'
          ELSE message || ',{{"role":"' || role || '","content":' || to_json(text)::VARCHAR || '}}' END || '],"stream_options":{{"include_usage":true}}}}'
        WHEN 'anthropic' THEN '{{"meta":{_ODD_SQL},"stream":true,"top_p":1e0,"system":' || {_NOTED} || ',"max_tokens":1.0}}'
        ELSE '{{"meta":{_ODD_SQL},"input":[' || message || ',{{"role":"user","content":' || to_json(text)::VARCHAR || '}}],"instructions":' || {_NOTE_SQL} || ',  "seed":7}}' END AS body, true AS once, true AS same FROM m""",
    "request_summaries": f"""{_TURNS} SELECT stream, role AS model, n AS seed, sha256(text) AS text, NULL::VARCHAR AS hidden FROM turns""",
}
