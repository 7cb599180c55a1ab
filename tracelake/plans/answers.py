"""Whole answers made of conversations and what the audit makes of them, and forms of commands and identifiers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bodies, shell, timewin
from ..operators import closing, identity, metrics, pii, toolcalls
from ..sources.driver_tables import REQUESTS_SQL, requests, samples, table
from .pump import _TURNS, turns
from .redaction import SALT
from .values import hmac_sql

_REASON = "危险 shell: rm -rf 递归强制删除"
SINCE = 473_360


def _answers(s, d):
    """An answer of each turn's protocol with its text and two calls, of which none, one or both are dangerous."""
    rows = turns(s, d)
    word = F.concat(F.lower(F.regexp_replace("word", "[^A-Za-z]", "")), F.lit("x"))
    args = [F.to_json(F.struct(F.concat(F.when(F.col("n") % m == 0, "rm -rf ").otherwise("ls "), word).alias("command"))) for m in (5, 3)]
    one = lambda **v: F.struct(*[x.alias(k) for k, x in v.items()])
    text, t = F.col("text"), F.lit
    chat = one(id=F.col("stream"), model=t("m"), choices=F.array(one(index=t(0), message=one(role=t("assistant"), content=text, tool_calls=F.array(*[one(id=t(f"c{k}"), type=t("function"), function=one(name=t("bash"), arguments=a)) for k, a in enumerate(args)])))))
    blocks = [one(type=t("text"), text=text, id=t(None).cast("string"), name=t(None).cast("string"), input=t(None).cast("struct<command:string>"))]
    blocks += [one(type=t("tool_use"), text=t(None).cast("string"), id=t(f"c{k}"), name=t("bash"), input=F.from_json(a, "command string")) for k, a in enumerate(args)]
    messages = one(id=F.col("stream"), type=t("message"), model=t("m"), role=t("assistant"), content=F.array(*blocks))
    items = [one(type=t("function_call"), call_id=t(f"c{k}"), name=t("bash"), arguments=a) for k, a in enumerate(args)]
    responses = one(id=F.col("stream"), object=t("response"), model=t("m"), output=F.array(*items), said=text)
    body = F.when(F.col("protocol") == "chat", F.to_json(chat)).when(F.col("protocol") == "anthropic", F.to_json(messages)).otherwise(F.to_json(responses))
    made = rows.select("stream", "protocol", body.alias("given")).withColumn("a", closing.audited_body(F.col("given"), F.col("protocol"), F.lit(1)))
    at = lambda p: F.get_json_object("a.body", p)
    said = F.coalesce(at("$.choices[0].message.content"), at("$.content[0].text"), at("$.error.message"), at("$.said"))
    return made.select("stream", "protocol", F.col("a.reason").alias("reason"), F.col("a.index").alias("index"), (F.col("a.body") == F.col("given")).alias("kept"), F.sha2(F.coalesce(said, F.lit("")), 256).alias("said"), at("$.id").alias("id"))


def _searches(s, d):
    """Searches in streams of responses: the tool by the event's kind, and what is asked."""
    rows = turns(s, d)
    kinds = ("response.web_search_call.searching", "response.file_search_call.searching", "response.code_interpreter_call_code.done", "response.mcp_call_arguments.done")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("n") % 4 + 1).cast("int"))
    call = F.to_json(F.struct(kind.alias("type"), (F.col("n") % 7).alias("output_index"), F.lit("i").alias("item_id"), F.when(F.col("n") % 4 < 2, F.struct(F.col("word").alias("query"))).alias("action"), F.when(F.col("n") % 4 == 2, F.col("word")).alias("code"), F.when(F.col("n") % 4 == 3, F.col("word")).alias("arguments")))
    first = F.get(toolcalls.tool_calls(F.col("call")), 0)
    return rows.withColumn("call", call).withColumn("c", first).select("stream", F.col("c.index").alias("index"), F.col("c.name").alias("name"), F.coalesce("c.args", F.lit("")).alias("args"))


def _identifiers(s, d):
    """Addresses of both kinds, keys, images and placeholders in running text, by event."""
    e = table(s, d, "events")
    i = F.col("event_id")
    odd = (
        F.when(i % 5 == 0, F.concat(F.lit("2001:db9::"), F.lower(F.hex(i + 1)))).when(i % 5 == 1, F.concat(F.lit("data:image/png;base64,13800138000"), i)).when(i % 5 == 2, F.concat(F.lit("__PII_"), i, F.lit("_13800138__")))
        .when(i % 5 == 3, F.concat(F.lit("8.8."), i % 250 + 1, F.lit(".7"))).otherwise(F.concat(F.lit("sk-proj-"), F.lpad(i.cast("string"), 20, "0")))
    )
    found = pii.with_hits(e.select("event_id", F.concat(F.lit("see "), odd, F.lit(" now")).alias("text")))
    return found.select("event_id", F.array_join(F.transform("pii_hits", lambda h: F.concat(h["kind"], F.lit("="), h["value"])), ",").alias("hits"))


def _commands(s, d):
    e = table(s, d, "events").select("event_id", (F.col("event_id") % 50).cast("string").alias("k"), F.col("user_id").cast("string").alias("u"))
    path = F.concat(F.lit("/srv//"), "k", F.lit("/./x/../"), "u", F.lit("/../../y/"))
    line = F.concat(F.lit("A="), "k", F.lit("; echo $A ${A} $B \\x41\\u00e9\\\\n"), "u")
    return e.select("event_id", shell.plain_path(path).alias("path"), shell.unescape(line).alias("line"), shell.expand(F.concat(F.lit("A="), "k", F.lit("; echo $A/${A} $B"))).alias("expanded"))


def _prescan(s, d):
    """Long words as a user's pattern finds them in documents, and the first of their placeholders."""
    docs = table(s, d, "documents").select("doc_id", pii.prescan(F.col("text"), [("long", "[a-z]{11,}")], SALT, F.col("doc_id")).alias("m"))
    keys = F.map_keys("m")
    return docs.select("doc_id", F.size(keys).cast("bigint").alias("values"), F.sha2(F.array_join(keys, " "), 256).alias("found"), F.get(F.map_values("m"), 0).alias("first"))


def _places(s, d):
    part = F.lower(F.col("role").substr(F.lit(1), F.lit(2)))
    rows = table(s, d, "conversations").select("conv_id", "turn", bodies.occurrence_spans(F.coalesce("text", F.lit("")), part).alias("p"))
    return rows.select("conv_id", "turn", F.size("p").cast("bigint").alias("places"), F.array_join(F.transform("p", lambda x: F.concat(x["start"], F.lit(":"), x["end"])), ",").alias("spans"))


def _callers(s, d):
    c = table(s, d, "customer")
    n = F.col("c_custkey")
    return c.select(F.concat(F.lit("/srv/"), n).alias("caller_path"), F.concat(F.lit("h"), n % 40).alias("expected_hash"), F.concat(F.lit("n"), n % 60).alias("name"), (n % 3 == 0).alias("revoked"))


def _found(s, d):
    n = F.col("event_id")
    key = F.when(n % 4 == 0, F.concat(F.lit("/srv/"), n % 500)).when(n % 4 == 1, F.concat(F.lit("h"), n % 60)).when(n % 4 == 2, F.concat(F.lit("n"), n % 90)).otherwise("none")
    return identity.found_entries(table(s, d, "events").select("event_id", key.alias("key")), _callers(s, d))


QUERIES = {
    "prescanned_values": _prescan,
    "part_spans": _places,
    "found_entries": _found,
    "audited_bodies": _answers,
    "search_calls": _searches,
    "odd_identifiers": _identifiers,
    "command_forms": _commands,
    "civil_days": lambda s, d: requests(s, d).groupBy(timewin.civil_day(F.col("ts_secs")).alias("day")).agg(F.count("*").alias("requests")),
    "series_since": lambda s, d: metrics.series(metrics.rollup(samples(s, d), ("h",)), "h", SINCE, "chat/completions").select("granularity", "window_ord", "protocol", "requests", "ts_start"),
}
_LOG = f"WITH {REQUESTS_SQL.strip()}"
_BLOCKED = f"'[blocked: {_REASON}]'"
_FIRST = hmac_sql(SALT, "doc_id || chr(31) || v[1]")
ORACLE_SQL = {
    "prescanned_values": f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[a-z]{{11,}}') AS ws FROM documents),
      v AS (SELECT doc_id, list_filter(ws, lambda x, i: list_position(ws, x) = i) AS v FROM w)
      SELECT doc_id, len(v) AS "values", sha256(array_to_string(v, ' ')) AS found, CASE WHEN len(v) > 0 THEN '__PII_1_' || substr({_FIRST}, 1, 8) || '__' END AS first FROM v""",
    "part_spans": """WITH t AS (SELECT conv_id, turn, string_split(coalesce(text, ''), lower(substr(role, 1, 2))) AS ps FROM conversations),
      e AS (SELECT conv_id, turn, ps, unnest(range(1, len(ps))) AS k FROM t),
      s AS (SELECT conv_id, turn, k, list_sum(list_transform(ps[:k], lambda x: length(x))) + 2 * (k - 1) AS place FROM e)
      SELECT t.conv_id, t.turn, count(k) AS places, coalesce(string_agg(CAST(place AS BIGINT) || ':' || CAST(place + 2 AS BIGINT), ',' ORDER BY k), '') AS spans FROM t LEFT JOIN s USING (conv_id, turn) GROUP BY ALL""",
    "found_entries": """WITH c AS (SELECT '/srv/' || c_custkey AS p, 'h' || c_custkey % 40 AS h, 'n' || c_custkey % 60 AS n, c_custkey % 3 = 0 AS revoked FROM customer),
      k AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '/srv/' || event_id % 500 WHEN 1 THEN 'h' || event_id % 60 WHEN 2 THEN 'n' || event_id % 90 ELSE 'none' END AS key FROM events),
      a AS (SELECT p AS x, p AS y FROM c), b AS (SELECT h AS x, min(p) AS y FROM c GROUP BY h), n AS (SELECT n AS x, coalesce(min(p) FILTER (WHERE NOT revoked), min(p)) AS y FROM c GROUP BY n)
      SELECT event_id, key, coalesce(a.y, b.y, n.y) AS entry_path FROM k LEFT JOIN a ON a.x = key LEFT JOIN b ON b.x = key LEFT JOIN n ON n.x = key""",
    "audited_bodies": f"""{_TURNS}, c AS (SELECT *, n % 5 = 0 OR n % 3 = 0 AS bad, CASE WHEN n % 5 = 0 THEN 0 WHEN n % 3 = 0 THEN 1 END AS k FROM turns)
      SELECT stream, protocol, CASE WHEN bad THEN '{_REASON}' END AS reason, CAST(CASE protocol WHEN 'anthropic' THEN k + 1 ELSE k END AS BIGINT) AS index, NOT bad AS kept,
        sha256(CASE WHEN bad THEN {_BLOCKED} ELSE text END) AS said, CASE WHEN bad AND protocol = 'chat' THEN 'blocked-' || stream ELSE stream END AS id FROM c""",
    "search_calls": rf"""{_TURNS} SELECT stream, CAST(n % 7 AS BIGINT) AS index, list_extract(['web_search', 'file_search', 'code_interpreter', 'mcp'], n % 4 + 1) AS name, regexp_extract(text, '^\S+') AS args FROM turns""",
    "odd_identifiers": """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'ipv6=2001:db9::' || printf('%x', event_id + 1) WHEN 3 THEN 'ipv4=8.8.' || event_id % 250 + 1 || '.7' WHEN 4 THEN 'api_key=sk-proj-' || lpad(event_id::VARCHAR, 20, '0') ELSE '' END AS hits FROM events""",
    "command_forms": r"""SELECT event_id, '/srv/y' AS path, 'A=' || event_id % 50 || '; echo $A ${A} $B Aé\n' || user_id AS line, 'A=' || event_id % 50 || '; echo ' || event_id % 50 || '/' || event_id % 50 || ' $B' AS expanded FROM events""",
    "civil_days": f"{_LOG} SELECT strftime(make_timestamp(ts_secs * 1000000), '%Y-%m-%d') AS day, count(*) AS requests FROM requests GROUP BY 1",
    "series_since": f"""{_LOG} SELECT 'h' AS granularity, CAST(floor(ts_secs / 3600.0) AS BIGINT) AS window_ord, protocol, count(*) AS requests, CAST(floor(ts_secs / 3600.0) AS BIGINT) * 3600 AS ts_start
      FROM samples WHERE protocol = 'chat/completions' AND floor(ts_secs / 3600.0) >= {SINCE} GROUP BY 2, 3 ORDER BY 2 LIMIT 500""",
}
