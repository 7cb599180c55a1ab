"""Queries over what ends streams and decisions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import closing
from ..sources.driver_tables import NOW, table

EV = "ev AS (SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS ts_secs, user_id, event_type AS kind FROM events)"


def _events(s, d):
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(s, d, "events").select(F.col("event_id").alias("id"), seconds.alias("ts_secs"), "user_id", F.col("event_type").alias("kind"))


def _blocked(s, d):
    i = F.col("id")
    protocol = F.when(i % 4 == 0, "chat").when(i % 4 == 1, "anthropic").when(i % 4 == 2, "responses").otherwise("passthrough")
    return _events(s, d).select("id", closing.blocked_body(protocol, F.col("kind"), F.when(i % 5 != 0, F.concat(F.lit("c"), i)), F.when(i % 3 == 0, "m1").otherwise(""), F.col("ts_secs")).alias("body"))


def _tables(s, d):
    bit = lambda k: F.col("id").bitwiseAND(1 << k) != 0
    protocol = F.when(F.col("id") % 3 == 0, "responses").otherwise("chat")
    return _events(s, d).select(
        "id", closing.control_action(bit(0), bit(1), bit(2), bit(3)).alias("control"), closing.sticky_drop(bit(0), bit(1), bit(2), bit(3), bit(4)).alias("sticky"),
        closing.terminal_due(protocol, bit(0), bit(1), bit(2), bit(3)).alias("terminal"), closing.buffered(bit(0), bit(1), bit(2), bit(3)).alias("buffered"),
    )


def _frames(s, d):
    return _events(s, d).select(F.col("user_id").alias("stream"), F.col("id").alias("seq"), ((F.col("user_id") % 3 != 0) & (F.col("id") % 50 == 7)).alias("terminal"))


def _parameters(s, d):
    i = F.col("id")
    pair = lambda *kv: F.create_map(*[x for k, v in kv for x in (F.lit(k), v)])
    body = F.when(i % 2 == 0, pair(("temperature", i.cast("string")), ("top_p", F.lit("1")))).otherwise(pair(("model", F.lit("m"))))
    made = closing.merged_parameters(body, pair(("temperature", F.lit("0")), ("seed", F.lit("7"))), F.when(i % 3 == 0, pair(("top_p", F.lit("0.5")))).otherwise(pair(("user", F.lit("u")))), F.when(i % 5 == 0, F.array(F.lit("seed"))).otherwise(F.array(F.lit("stop"))))
    return _events(s, d).select("id", F.array_join(F.array_sort(F.transform(F.map_entries(made), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("parameters"))


QUERIES = {
    "blocked_bodies": _blocked,
    "stream_decisions": _tables,
    "stream_terminals": lambda s, d: closing.with_terminals(_frames(s, d)),
    "stream_log_rows": lambda s, d: closing.stream_rows(_events(s, d).select(F.col("user_id").alias("stream"), "ts_secs", (F.lit(200) + F.col("id") % 5).alias("status"), ((F.col("user_id") % 4 != 0) & (F.col("kind") == "purchase")).alias("finished"))),
    "frames_by_slot": lambda s, d: closing.by_slot(_events(s, d).select(F.col("user_id").alias("stream"), (F.col("id") * 7 % 5).alias("slot"), F.col("id").alias("seq"))),
    "disabled_rules": lambda s, d: closing.disabled_rules(_events(s, d).select((F.col("user_id") % 40).alias("rule"), F.col("id").alias("seq"), F.col("kind").isin("error", "view").alias("failed"))),
    "first_blocking_calls": lambda s, d: closing.first_blocks(_events(s, d).select(F.col("user_id").alias("body"), F.col("id").alias("pos"), F.when(F.col("kind") == "error", F.concat(F.lit("r"), "id")).alias("reason"))),
    "audit_log_rows": lambda s, d: closing.audit_rows(
        _events(s, d).select("id", F.when(F.col("kind") == "error", "block").when(F.col("kind") == "click", "need_approval").otherwise("allow").alias("verdict"), F.when(F.col("kind") == "error", "r").alias("reason")), F.concat(F.lit("s"), "id"), "block"
    ),
    "tickets": lambda s, d: _events(s, d).select("id", closing.ticket(F.col("kind"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("c"), "user_id")), F.lit("mail"), F.when(F.col("id") % 2 == 0, "").otherwise("user")).alias("ticket")),
    "merged_parameters": _parameters,
    "open_decisions": lambda s, d: closing.open_decisions(_events(s, d).select(F.col("user_id").alias("key"), "ts_secs", "id"), 7_200),
    "unexpired_keys": lambda s, d: closing.unexpired(_events(s, d).select(F.col("user_id").alias("key"), "ts_secs"), NOW, 86_400),
    "event_frames": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", closing.event_frame(F.when(F.col("turn") % 2 == 0, F.col("role")), F.concat(F.lit("a\r\nb\r"), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]", " "))).alias("frame")),
}
_BIT = lambda k: f"(id & {1 << k}) <> 0"
_TEXT = "'[blocked: ' || kind || ']'"
_MODEL = "CASE WHEN id % 3 = 0 THEN 'm1' ELSE 'unknown_model' END"
_OWN = "CASE WHEN id % 5 <> 0 THEN 'c' || id ELSE 'blocked-0' END"
_OVER = "CASE WHEN id % 3 = 0 THEN '0.5' ELSE '1' END"
ORACLE_SQL = {
    "blocked_bodies": f"""WITH {EV} SELECT id, CASE id % 4
      WHEN 0 THEN '{{"id":"blocked-' || CASE WHEN id % 5 <> 0 THEN 'c' || id ELSE 'unknown' END || '","object":"chat.completion","created":' || ts_secs || ',"model":"' || {_MODEL} || '","choices":[{{"index":0,"finish_reason":"stop","message":{{"role":"assistant","content":"' || {_TEXT} || '"}}}}],"usage":{{"prompt_tokens":0,"completion_tokens":1,"total_tokens":1}}}}'
      WHEN 1 THEN '{{"id":"' || {_OWN} || '","type":"message","role":"assistant","model":"' || {_MODEL} || '","content":[{{"type":"text","text":"' || {_TEXT} || '"}}],"stop_reason":"end_turn","usage":{{"input_tokens":0,"output_tokens":1}}}}'
      WHEN 2 THEN '{{"id":"' || {_OWN} || '","object":"response","created_at":' || ts_secs || ',"model":"' || {_MODEL} || '","status":"failed","output":[],"error":{{"code":"blocked","message":"' || {_TEXT} || '"}}}}' END AS body FROM ev""",
    "stream_decisions": f"""WITH {EV} SELECT id, CASE WHEN {_BIT(0)} THEN 'ignore' WHEN {_BIT(2)} THEN 'synthesize_failed' WHEN {_BIT(3)} AND {_BIT(1)} THEN 'duplicate_failed' ELSE 'pass' END AS control, {_BIT(0)} AND (id & 30) <> 0 AS sticky,
      NOT ({_BIT(0)}) AND NOT ({_BIT(1)}) AND (id & 12) <> 0 AND (id % 3 <> 0 OR {_BIT(2)}) AS terminal, (id & 15) = 3 AS buffered FROM ev""",
    "stream_terminals": """WITH f AS (SELECT user_id AS stream, event_id AS seq, user_id % 3 <> 0 AND event_id % 50 = 7 AS terminal FROM events), g AS (SELECT *, min(CASE WHEN terminal THEN seq END) OVER (PARTITION BY stream) AS first FROM f)
      SELECT stream, seq, terminal, false AS synthetic FROM g WHERE NOT terminal OR seq = first UNION ALL SELECT stream, max(seq) + 1, true, true FROM g GROUP BY stream HAVING NOT bool_or(terminal)""",
    "stream_log_rows": f"""WITH {EV}, r AS (SELECT *, user_id % 4 <> 0 AND kind = 'purchase' AS fin FROM ev) SELECT user_id AS stream, min(ts_secs) AS started, (max(ts_secs) - min(ts_secs)) * 1000 AS latency_ms,
      max(CASE WHEN fin THEN 200 + id % 5 END) AS status, CASE WHEN NOT bool_or(fin) THEN 'client_aborted' END AS error_kind, count(*) AS events FROM r GROUP BY 1""",
    "frames_by_slot": """WITH f AS (SELECT user_id AS stream, event_id * 7 % 5 AS slot, event_id AS seq FROM events), g AS (SELECT *, min(seq) OVER (PARTITION BY stream, slot) AS opened FROM f)
      SELECT stream, slot, seq, row_number() OVER (PARTITION BY stream ORDER BY opened, slot, seq) - 1 AS place FROM g""",
    "disabled_rules": """WITH r AS (SELECT user_id % 40 AS rule, event_id AS seq, event_type IN ('error', 'view') AS f FROM events), l AS (SELECT *, lag(f) OVER w AS f1, lag(f, 2) OVER w AS f2 FROM r WINDOW w AS (PARTITION BY rule ORDER BY seq))
      SELECT rule, min(seq) AS disabled_at FROM l WHERE f AND f1 AND f2 GROUP BY 1""",
    "first_blocking_calls": "SELECT user_id AS body, 'r' || min(event_id) AS reason, min(event_id) AS pos, count(*) AS blocking FROM events WHERE event_type = 'error' GROUP BY 1",
    "audit_log_rows": "SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'block' WHEN 'click' THEN 'approval' ELSE 'allow' END AS kind, 's' || event_id AS summary, CASE WHEN event_type = 'error' THEN 'r' END AS reason FROM events",
    "tickets": "SELECT event_id AS id, concat_ws(chr(10), 'reason: ' || event_type, CASE WHEN event_id % 3 <> 0 THEN 'caller: c' || user_id END, 'entry: mail', CASE WHEN event_id % 2 <> 0 THEN 'field: user' END) AS ticket FROM events",
    "merged_parameters": f"""WITH {EV} SELECT id, concat_ws(',', CASE WHEN id % 2 <> 0 THEN 'model=m' END, CASE WHEN id % 5 <> 0 THEN 'seed=7' END, 'temperature=' || CASE WHEN id % 2 = 0 THEN CAST(id AS VARCHAR) ELSE '0' END,
      CASE WHEN id % 2 = 0 OR id % 3 = 0 THEN 'top_p=' || {_OVER} END, CASE WHEN id % 3 <> 0 THEN 'user=u' END) AS parameters FROM ev""",
    "open_decisions": f"""WITH {EV} SELECT user_id AS key, id, ts_secs, coalesce(ts_secs - lag(ts_secs) OVER (PARTITION BY user_id ORDER BY ts_secs, id) <= 7200, false) AS open FROM ev""",
    "unexpired_keys": f"WITH {EV} SELECT user_id AS key, max(ts_secs) AS last_ts FROM ev GROUP BY 1 HAVING max(ts_secs) > {NOW - 86_400}",
    "event_frames": r"""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'event: ' || role || chr(10) ELSE '' END || 'data: a' || chr(10) || 'data: b' || chr(10) || 'data: ' || regexp_replace(coalesce(text, ''), '[\r\n]', ' ', 'g') || chr(10) || chr(10) AS frame FROM conversations""",
}
