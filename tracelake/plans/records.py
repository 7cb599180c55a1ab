"""Queries over logs, life spans and block frames, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bodies, jsonspan
from ..operators import access, pii, records
from ..sources.driver_tables import NOW, REQUESTS_SQL, requests, table

TOKEN = "__PII_[0-9]+_[0-9a-f]{8}__"
NOTE = "Keep placeholders as they are."
EVENTS = ("message_stop", "[DONE]", "content_block_stop", "response.function_call_arguments.delta", "response.output_text.delta", "ping", "other", "response.shell_call_command.delta")
CLASSES = ("terminal", "terminal", "closing", "tool", "text", "control", "other", "tool")
DECISIONS = ("approve", "approve_always", "reject", "timeout")
EV = "ev AS (SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS ts_secs, user_id, event_type AS kind FROM events)"


def _pick(words, by):
    return F.element_at(F.array(*[F.lit(w) for w in words]), (by % len(words) + 1).cast("int"))


def _pick_sql(words, by):
    return "list_extract([" + ", ".join(f"'{w}'" for w in words) + f"], CAST({by} % {len(words)} + 1 AS BIGINT))"


def _events(s, d):
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(s, d, "events").select(F.col("event_id").alias("id"), seconds.alias("ts_secs"), "user_id", F.col("event_type").alias("kind"))


def _log(s, d):
    i = F.col("id")
    return _events(s, d).select("id", F.concat(F.lit('{"token": "'), i, F.lit('", "to": "a'), i, F.lit('@ex.org"}')).alias("params_json"), F.concat(F.lit("key sk-"), i, F.lit("\x07 done")).alias("stdout"), F.repeat(F.lit("ab"), 1100).alias("stderr"))


def _hardened(s, d):
    i = F.col("id")
    text = F.concat(F.when(i % 3 == 0, "x").otherwise(""), F.lit("13800138000"), F.when(i % 4 == 0, "y").otherwise(""), F.lit(" at "), F.when(i % 5 == 0, "08.8.8.8").otherwise("8.8.8.8"))
    rows = _events(s, d).select("id", text.alias("text"))
    return pii.with_hits(rows).select("id", F.size(pii.hardened(F.col("text"), F.col("pii_hits"))).alias("hits"))


def _spans(s, d):
    i = F.col("id")
    token = F.concat(F.lit("__PII_"), i, F.lit("_0a1b2c3d__"))
    text = F.concat(F.lit("ab "), token, F.lit(" c __PII_0_ffffffff__ "), token)
    made = records.restored_spans(text, F.create_map(token, F.concat(F.lit("v"), i)), TOKEN)
    return _events(s, d).select("id", made.alias("m")).select("id", "m.text", F.array_join(F.transform("m.spans", lambda x: F.concat_ws(":", x["text"], x["start"], x["end"])), ",").alias("spans"))


def _frames(s, d):
    i = F.col("id")
    protocol = F.when(i % 3 == 0, "chat").when(i % 3 == 1, "anthropic").otherwise("responses")
    frames = records.block_frames(protocol, F.col("kind"), F.concat(F.lit("c"), i), F.when(i % 2 == 0, i))
    each = _events(s, d).select("id", F.posexplode(frames).alias("pos", "f"))
    return each.select("id", "pos", "f.event", F.get_json_object("f.data", "$.sequence_number").alias("number"), F.get_json_object("f.data", "$.text").alias("text"))


def _factors(s, d):
    i = F.col("id")
    given = access.three_factors(F.when(i % 3 != 0, "/p").otherwise(" "), F.when(i % 5 != 0, "h"), F.when(i % 2 == 0, "b").otherwise("c"), "b", F.lit(None).cast("string"), None)
    kind = F.when(i % 3 == 0, "enum").when(i % 3 == 1, "integer").otherwise("string")
    value = F.when(i % 7 == 0, F.lit(None).cast("string")).when(i % 4 == 0, "-1").when(i % 4 == 1, "12").otherwise("red")
    return _events(s, d).select("id", given.alias("good"), access.parameter_error(kind, F.array(F.lit("red"), F.lit("blue")), value).alias("error"), access.listed(F.col("kind"), ("click", "view")).alias("listed"), access.listed(F.col("kind"), ()).alias("free"))


def _registered(s, d):
    i = F.col("id")
    return _events(s, d).select("id", records.registration_result(_pick(DECISIONS, i), i % 5 == 0, NOW).alias("r"), records.revocation_result(F.when(i % 2 == 0, _pick(DECISIONS, i)), i % 7 == 0).alias("gone")).select("id", "r.*", "gone")


QUERIES = {
    "logged_commands": lambda s, d: records.logged_commands(_log(s, d)),
    "log_lines": lambda s, d: records.log_lines(_log(s, d).select("id", "params_json")),
    "prefix_hints": lambda s, d: records.prefix_hints(table(s, d, "part"), "p_name"),
    "hardened_hits": _hardened,
    "prompt_summaries": lambda s, d: _events(s, d).select("id", records.prompt_summary(F.concat(F.lit("m"), F.col("id") % 3), F.create_map(F.lit("top_p"), F.lit("1"), F.lit("seed"), F.col("user_id").cast("string")), F.array(F.col("kind"), F.concat(F.lit("mail a"), "id", F.lit("@ex.org")))).alias("summary")),
    "json_shapes": lambda s, d: table(s, d, "events").select("event_id", bodies.same_shape(F.to_json(F.struct(F.col("props").alias("p"))), F.to_json(F.struct(F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("{broken").alias("p"))), ("$.p",)).alias("same")),
    "restored_spans": _spans,
    "noted_bodies": lambda s, d: _events(s, d).select("id", jsonspan.with_note(F.when(F.col("id") % 3 == 0, '{"messages":[]}').when(F.col("id") % 3 == 1, '{"m":1,"messages": [{"role":"user"}]}').otherwise('{"input":[]}'), NOTE, F.lit("chat")).alias("body")),
    "entry_properties": lambda s, d: table(s, d, "customer").select("c_custkey", F.array_join(F.array_sort(F.transform(F.map_entries(records.entry_properties(F.col("c_name"), F.lit(""), F.format_string("__CRED_%06d__", "c_custkey"), F.lit("u"), F.create_map(F.lit("pin"), F.lit("1"), F.lit("url"), F.lit("x")))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("properties")),
    "event_classes": lambda s, d: _events(s, d).select("id", records.event_class(_pick(EVENTS, F.col("id"))).alias("class")),
    "held_until": lambda s, d: records.held_until(_events(s, d).select(F.col("user_id").alias("stream"), F.col("id").alias("seq"), (F.col("id") % 100).alias("size")), 40, 2_500),
    "block_frames": _frames,
    "stream_residue": lambda s, d: table(s, d, "events").select("event_id", records.residue(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("data: "), "props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("data: "), F.substring("props", 1, 4))).otherwise("12")).alias("kept")),
    "caller_factors": _factors,
    "expired_approvals": lambda s, d: records.expired_approvals(_events(s, d).select("id", F.when(F.col("kind") == "click", "credential").when(F.col("kind") == "view", "command").otherwise("audit").alias("branch"), F.col("ts_secs").alias("created")), NOW - 10 * 86_400),
    "execution_ends": lambda s, d: _events(s, d).select("id", records.execution_ends(F.when(F.col("kind") == "view", "pending").otherwise("done"), F.col("ts_secs"), F.col("user_id")).alias("ends")),
    "registration_results": _registered,
    "page_payloads": lambda s, d: requests(s, d).groupBy("protocol").agg(F.count("*").alias("n"), F.sum("prompt_tokens").alias("t")).select("protocol", records.page_payload(requests=F.col("n"), tokens=F.col("t"), series=F.array(F.col("n"))).alias("payload")),
}
_NAMES = "['response.created','response.output_item.added','response.output_text.delta','response.output_text.done','response.output_item.done','response.completed']"
_BLOCKS = "['message_start','content_block_start','content_block_delta','content_block_stop','message_stop']"
ORACLE_SQL = {
    "logged_commands": """SELECT event_id AS id, '{"token": "' || event_id || '", "to": "[REDACTED:email]"}' AS params_json, 'key [REDACTED:secret] done' AS stdout, repeat('ab', 1024) AS stderr FROM events""",
    "log_lines": r"""SELECT '{"id":' || event_id || ',"params_json":' || to_json('{"token": "' || event_id || '", "to": "[REDACTED:email]"}') || '}' AS line FROM events""",
    "prefix_hints": "SELECT name FROM (SELECT DISTINCT p_name AS name FROM part) ORDER BY length(name) DESC, name LIMIT 64",
    "hardened_hits": "SELECT event_id AS id, CAST(CASE WHEN event_id % 3 <> 0 AND event_id % 4 <> 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 5 <> 0 THEN 1 ELSE 0 END AS INTEGER) AS hits FROM events",
    "prompt_summaries": f"WITH {EV} SELECT id, 'model=m' || id % 3 || ' seed=' || user_id || ' top_p=1 ' || kind || ' mail [REDACTED:email]' AS summary FROM ev",
    "json_shapes": "SELECT event_id, event_id % 2 = 0 AS same FROM events",
    "restored_spans": """SELECT event_id AS id, 'ab v' || event_id || ' c __PII_0_ffffffff__ v' || event_id AS text,
      'v' || event_id || ':3:' || 4 + length(event_id::VARCHAR) || ',v' || event_id || ':' || 26 + length(event_id::VARCHAR) || ':' || 27 + 2 * length(event_id::VARCHAR) AS spans FROM events""",
    "noted_bodies": f"""SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN '{{"messages":[{{"role":"system","content":"{NOTE}"}}]}}' WHEN 1 THEN '{{"m":1,"messages": [{{"role":"system","content":"{NOTE}"}},{{"role":"user"}}]}}' ELSE '{{"input":[]}}' END AS body FROM events""",
    "entry_properties": "SELECT c_custkey, 'password=' || printf('__CRED_%06d__', c_custkey) || ',pin=1,title=' || c_name || ',url=u' AS properties FROM customer",
    "event_classes": f"SELECT event_id AS id, {_pick_sql(CLASSES, 'event_id')} AS class FROM events",
    "held_until": """WITH f AS (SELECT user_id AS stream, event_id AS seq, event_id % 100 AS size FROM events), g AS (SELECT *, count(*) OVER w > 40 OR sum(size) OVER w > 2500 AS o FROM f WINDOW w AS (PARTITION BY stream ORDER BY seq))
      SELECT stream, min(CASE WHEN o THEN seq END) AS rejected_at, CAST(sum(size) AS BIGINT) AS bytes FROM g GROUP BY 1""",
    "block_frames": f"""WITH {EV}, f AS (SELECT id, kind, unnest(range(CASE id % 3 WHEN 0 THEN 3 WHEN 1 THEN 5 ELSE 6 END)) AS pos FROM ev)
      SELECT id, CAST(pos AS INTEGER) AS pos, CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN list_extract({_BLOCKS}, pos + 1) ELSE list_extract({_NAMES}, pos + 1) END AS event,
        CASE WHEN id % 3 = 2 THEN CAST(CASE WHEN id % 2 = 0 THEN id + 1 ELSE 0 END + pos AS VARCHAR) END AS number, CASE WHEN id % 3 = 2 OR (id % 3 = 1 AND pos = 2) THEN '[blocked: ' || kind || ']' END AS text FROM f""",
    "stream_residue": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props END AS kept FROM events",
    "caller_factors": f"""WITH {EV} SELECT id, id % 3 <> 0 AND id % 5 <> 0 AND id % 2 = 0 AS good, CASE WHEN id % 7 = 0 THEN 'missing' WHEN id % 3 = 0 AND id % 4 < 2 THEN 'not in the list' WHEN id % 3 = 1 AND id % 4 <> 1 THEN 'no integer'
      WHEN id % 3 = 2 AND id % 4 = 0 THEN 'leading dash' END AS error, kind IN ('click', 'view') AS listed, true AS free FROM ev""",
    "expired_approvals": f"""WITH {EV}, a AS (SELECT id, CASE kind WHEN 'click' THEN 'credential' WHEN 'view' THEN 'command' ELSE 'audit' END AS branch, ts_secs + CASE kind WHEN 'click' THEN 300 WHEN 'view' THEN 600 ELSE 60 END AS ended FROM ev)
      SELECT * FROM a WHERE ended < {NOW - 10 * 86_400}""",
    "execution_ends": f"WITH {EV} SELECT id, ts_secs + CASE WHEN kind = 'view' THEN 660 + user_id ELSE 300 END AS ends FROM ev",
    "registration_results": f"""SELECT event_id AS id, y AS enabled, event_id % 5 = 0 OR event_id % 4 > 1 AS revoked, CASE WHEN y AND event_id % 4 = 1 THEN 'allow' END AS mode, CASE WHEN y THEN CAST({NOW} AS INTEGER) END AS authorized_at,
      event_id % 7 = 0 OR (event_id % 2 = 0 AND event_id % 4 = 0) AS gone FROM (SELECT event_id, event_id % 4 < 2 AND event_id % 5 <> 0 AS y FROM events)""",
    "page_payloads": f"""WITH {REQUESTS_SQL.strip()} SELECT protocol, '{{"requests":' || count(*) || ',"tokens":' || sum(prompt_tokens) || ',"series":[' || count(*) || ']}}' AS payload FROM requests GROUP BY 1""",
}
