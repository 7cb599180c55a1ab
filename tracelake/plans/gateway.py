"""Queries over headers, bodies, callers, commands and counters, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bodies, jsonspan, text, validators
from ..functions.timewin import is_since_shape, window_key
from ..operators import access, admin, identity, traffic
from ..sources.driver_tables import NOW, REQUESTS_SQL, requests, table
from .values import hmac_sql

KEY = b"fixed key of the gateway queries"
WORDS = ("allow", " Allowed", "pass", "approved", "block", "blocked", "deny", "rejected", "need_approval", "pending", "approval", "other", "")
REASONS = ("unlock now", " Revoke it", "hash_mismatch", "hash changed", "register me", "credential read", "command run", "audit hit", "else", "注册", "解锁", "吊销")
REACTIONS = ("♾️", "♾", "✅", " ❎ ", "👍", "")
KINDS = ("ok", "no_upstream", "pii_unavailable", "bad_request", "empty_body", "non_json", "oversize", "passthrough")
PATHS = ("/v1/chat/completions", "/V1/Messages?beta=1", "/v1/messages/count_tokens", "/v1/messages/batches", "/v1/responses/", "/v1/responses/r1", "/v1/responses/compact", "/v1/models")


def _pick(words: tuple[str, ...], column: str):
    return F.element_at(F.array(*[F.lit(w) for w in words]), (F.col(column) % len(words) + 1).cast("int"))


def _pick_sql(words: tuple[str, ...], column: str) -> str:
    return "list_extract([" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + f"], CAST({column} % {len(words)} + 1 AS BIGINT))"


def _events(s, d):
    e = table(s, d, "events")
    return e.select(F.col("event_id").alias("id"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("ts_secs"), F.col("event_type").alias("kind"), "user_id", "props")


EVENTS = "ev AS (SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS ts_secs, event_type AS kind, user_id, props FROM events)"


def _commands(s, d):
    return _events(s, d).select(
        "id", "ts_secs", F.concat(F.lit("/srv/c"), F.col("user_id")).alias("caller_path"), F.concat(F.lit("cmd-"), F.col("id") % 5).alias("command"),
        F.concat(F.lit("host-"), F.col("id") % 25).alias("host"), F.when(F.col("kind") == "error", "rejected").when(F.col("id") % 4 == 0, "pending").otherwise("approved").alias("approval_status"),
    )


COMMANDS = f"""{EVENTS}, commands AS (SELECT id, ts_secs, '/srv/c' || user_id AS caller_path, 'cmd-' || id % 5 AS command, 'host-' || id % 25 AS host,
  CASE WHEN kind = 'error' THEN 'rejected' WHEN id % 4 = 0 THEN 'pending' ELSE 'approved' END AS approval_status FROM ev)"""


def _callers(s, d):
    n = F.col("c_custkey")
    return table(s, d, "customer").select(
        F.concat(F.lit("/srv/c"), n).alias("caller_path"), F.col("c_name").alias("name"), (n % 7 == 0).alias("revoked"), (n % 3 != 0).alias("enabled"),
        F.when(n % 4 == 0, "allow").when(n % 4 == 1, "deny").when(n % 4 == 2, "pending").alias("allow_mode"), F.when(n % 5 == 0, "allow").when(n % 5 == 1, "pending").alias("auto_approve"),
        F.when(n % 6 != 0, F.lit(NOW) - n * 60).alias("authorized_at"), F.when(n % 8 != 0, n % 50 * 3600).alias("authorized_ttl_secs"),
        F.sha2(F.concat(F.lit("h"), n % 900), 256).alias("expected_hash"), F.sha2(F.concat(F.lit("old"), n), 256).alias("old_hash"), (F.lit(NOW) + n - 750).alias("old_hash_expires_at"),
    )


CALLERS = f"""callers AS (SELECT '/srv/c' || c_custkey AS caller_path, c_name AS name, c_custkey % 7 = 0 AS revoked, c_custkey % 3 <> 0 AS enabled,
  CASE c_custkey % 4 WHEN 0 THEN 'allow' WHEN 1 THEN 'deny' WHEN 2 THEN 'pending' END AS allow_mode, CASE c_custkey % 5 WHEN 0 THEN 'allow' WHEN 1 THEN 'pending' END AS auto_approve,
  CASE WHEN c_custkey % 6 <> 0 THEN {NOW} - c_custkey * 60 END AS authorized_at, CASE WHEN c_custkey % 8 <> 0 THEN c_custkey % 50 * 3600 END AS authorized_ttl_secs,
  sha256('h' || c_custkey % 900) AS expected_hash, sha256('old' || c_custkey) AS old_hash, {NOW} + c_custkey - 750 AS old_hash_expires_at FROM customer)"""


def _calls(s, d):
    u, i = F.col("user_id"), F.col("id")
    given = F.when(i % 3 == 0, F.sha2(F.concat(F.lit("h"), u % 900), 256)).when(i % 3 == 1, F.sha2(F.concat(F.lit("old"), u), 256)).otherwise(F.sha2(F.concat(F.lit("h"), i % 1000), 256))
    return _events(s, d).select("id", F.when(i % 5 == 4, F.concat(F.lit("/tmp/x"), i)).otherwise(F.concat(F.lit("/srv/c"), u)).alias("caller_path"), given.alias("caller_hash"))


CALLS = f"""{EVENTS}, {CALLERS}, calls AS (SELECT id, CASE WHEN id % 5 = 4 THEN '/tmp/x' || id ELSE '/srv/c' || user_id END AS caller_path,
  CASE id % 3 WHEN 0 THEN sha256('h' || user_id % 900) WHEN 1 THEN sha256('old' || user_id) ELSE sha256('h' || id % 1000) END AS caller_hash FROM ev),
 by_hash AS (SELECT expected_hash AS h, bool_and(revoked) AS h_revoked, min_by(caller_path, (CAST(revoked AS INT), caller_path)) AS h_path FROM callers GROUP BY 1),
 resolved AS (SELECT c.caller_path, c.caller_hash, CASE
    WHEN p.caller_path IS NOT NULL THEN CASE WHEN p.revoked THEN 'revoked' WHEN c.caller_hash = p.expected_hash THEN 'enrolled' WHEN c.caller_hash = p.old_hash AND {NOW} <= p.old_hash_expires_at THEN 'grace' ELSE 'mismatch' END
    WHEN b.h IS NOT NULL THEN CASE WHEN h_revoked THEN 'revoked' ELSE 'moved' END ELSE 'unknown' END AS outcome, coalesce(p.caller_path, h_path) AS entry_path
  FROM calls c LEFT JOIN callers p ON c.caller_path = p.caller_path LEFT JOIN by_hash b ON c.caller_hash = b.h)"""


def _resolved(s, d):
    return identity.resolve_callers(_calls(s, d).drop("id"), _callers(s, d), NOW)


def _decided(s, d):
    own = _callers(s, d).select(F.col("caller_path").alias("e"), access.allow_mode(F.col("allow_mode"), F.col("auto_approve"), "pending").alias("mode"), identity.expires_at(F.col("authorized_at"), F.col("authorized_ttl_secs")).alias("ends"))
    rows = _resolved(s, d).join(own, F.col("entry_path") == F.col("e"), "left")
    verdict = access.credential_decision(F.col("outcome"), F.col("mode"), F.col("ends") <= NOW, "pending")
    return rows.groupBy("outcome", verdict.alias("decision")).agg(F.count("*").alias("calls"))


def _aux(s, d):
    e = _events(s, d)
    return e.select(window_key(F.col("ts_secs"), "h").alias("window"), F.col("kind").alias("protocol"), "ts_secs", F.col("user_id").alias("pii_hits"), (F.col("id") % 3 - 1).alias("pii_miss"),
                    F.get_json_object("props", "$.k").alias("cred_hits"), F.when(F.col("id") % 9 == 0, "x").otherwise("2").alias("audit_blocks"))


AUX = f"""{EVENTS}, aux AS (SELECT 'h' || CAST(ts_secs // 3600 AS BIGINT) AS "window", kind AS protocol, ts_secs, user_id AS pii_hits, greatest(id % 3 - 1, 0) AS pii_miss,
  coalesce(greatest(CAST(json_extract_string(props, '$.k') AS BIGINT), 0), 0) AS cred_hits, CASE WHEN id % 9 = 0 THEN 0 ELSE 2 END AS audit_blocks FROM ev)"""
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in admin.AUX)


def _headers(s, d):
    i = F.col("id")
    names = ("connection", "x-a", "te", "content-type", "x-internal-key", "accept", "upgrade", "session_id", "x-request-id")
    values = (F.when(i % 2 == 0, "X-A, keep-alive").otherwise("close"), i.cast("string"), F.lit("t"), F.lit("json"), F.lit("s"), F.lit("*"), F.lit("h2"), F.when(i % 3 == 0, F.concat(F.lit("s"), i)).when(i % 3 == 1, " ").otherwise("a\tb"), F.concat(F.lit("r."), i, F.when(i % 4 == 0, "!").otherwise("")))
    pairs = [x for n, v in zip(names, values) for x in (F.lit(n), v)]
    return _events(s, d).select("id", F.create_map(*pairs).alias("headers"))


def _credentials(s, d):
    words = F.array(F.col("n_name"), F.lit(""), F.lit("b"), F.col("n_name"), F.concat(F.lit("k"), F.col("n_nationkey")))
    return table(s, d, "nation").select("n_nationkey", F.concat(F.lit("https://h"), F.col("n_regionkey")).alias("base"), words.alias("creds"))


_CREDS = r"array_to_string(list_sort(list_distinct(list_filter([n_name, '', 'b', n_name, 'k' || n_nationkey], lambda x: x <> ''))), chr(30))"


def _conversation_keys(s, d):
    t = identity.first_texts(table(s, d, "conversations"))
    n = F.col("conv_id")
    prefix = bodies.stable_prefix(F.array(F.struct(F.lit("web").alias("name")), F.struct(F.lit("bash").alias("name"))), F.col("system_text"), F.col("first_user_text"))
    protocol = F.when(n % 3 == 0, "chat").when(n % 3 == 1, "anthropic").otherwise("responses")
    key = bodies.conversation_key(
        KEY, F.lit("tenant"), protocol, F.when(n % 5 == 0, F.concat(F.lit("h"), n)).when(n % 5 == 1, F.lit("")), F.when(n % 4 == 0, F.concat(F.lit("c"), n)), F.when(n % 7 == 0, F.concat(F.lit("e"), n)), F.when(n % 11 == 0, prefix)
    )
    return t.select("conv_id", key.alias("conversation"), F.when(n % 11 == 0, F.sha2(prefix, 256)).alias("prefix"))


_PREFIX = """'{"tools":[{"name":"bash"},{"name":"web"}],"system":' || to_json(coalesce(system_text, '')) || ',"user":' || to_json(first_user_text) || '}'"""
_SHAPES = ("", ',"stream_options":null', ',"stream_options":{}', ',"stream_options":{"include_usage":false}', ',"stream_options":{"x":1}', ',"stream_options":"no"')
_WITH = (',"stream_options":{"include_usage":true}', ',"stream_options":null', ',"stream_options":{"include_usage":true}', ',"stream_options":{"include_usage":false}', ',"stream_options":{"include_usage":true,"x":1}', ',"stream_options":{"include_usage":true}')


def _bodies(s, d):
    i = F.col("id")
    streamed = F.when(i % 4 == 0, ',"stream":true').when(i % 4 == 1, ',"stream":"true"').when(i % 4 == 2, ',"stream":false').otherwise("")
    return _events(s, d).select("id", F.concat(F.lit('{"model":"m'), i, F.lit('"'), streamed, _pick(_SHAPES, "id"), F.lit("}")).alias("body"))


def _tokens(s, d):
    n = F.col("event_id")
    t = F.concat(F.lit("a "), F.when(n % 3 == 0, F.concat(F.lit("__PII_"), n, F.lit("_0a1b2c3d__"))).when(n % 3 == 1, F.format_string("__CRED_%06d__", n)).otherwise("__CRED_12__"), F.lit(" b __PIX__"))
    return table(s, d, "events").select("event_id", t.alias("t"))


_TOKEN_TEXT = "'a ' || CASE event_id % 3 WHEN 0 THEN '__PII_' || event_id || '_0a1b2c3d__' WHEN 1 THEN printf('__CRED_%06d__', event_id) ELSE '__CRED_12__' END || ' b __PIX__'"


def _luhn(s, d):
    v = F.concat(F.lit("4"), F.lpad((F.col("o_orderkey") * 7919).cast("string"), 15, "1"))
    return table(s, d, "orders").select("o_orderkey", v.alias("value"), validators.luhn_ok(v).alias("luhn"))


_OCTETS = lambda: F.concat_ws(".", F.col("user_id") % 260, F.col("event_id") % 256, F.concat(F.when(F.col("event_id") % 3 == 0, "0").otherwise(""), F.col("event_id") % 10), F.lit("7"))
_SCOPES = "SELECT s_suppkey % 40 AS owner, CASE WHEN s_suppkey % 3 = 0 THEN r_name ELSE n_name END AS scope FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _scopes(s, d):
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    owners = table(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    scopes = owners.select((F.col("s_suppkey") % 40).alias("owner"), F.when(F.col("s_suppkey") % 3 == 0, F.col("r_name")).otherwise(F.col("n_name")).alias("scope"))
    return scopes, n.select(F.col("r_name").alias("grp"), F.col("n_name").alias("host"))


def _allowed(s, d):
    scopes, groups = _scopes(s, d)
    rules = scopes.select(F.concat(F.lit("/srv/c"), "owner").alias("rule_caller"), F.when(F.col("owner") % 2 == 0, "*").otherwise("cmd-1").alias("rule_command"), "scope")
    names = table(s, d, "nation").select(F.col("n_nationkey"), F.col("n_name"))
    calls = _commands(s, d).withColumn("k", F.regexp_extract("host", r"\d+", 0).cast("int")).join(F.broadcast(names), F.col("k") == F.col("n_nationkey")).select("caller_path", "command", F.col("n_name").alias("host"))
    return access.command_allowed(calls, rules, groups).groupBy("command", "allowed").agg(F.count("*").alias("calls"))


QUERIES = {
    "verdict_words": lambda s, d: _events(s, d).select("id", admin.normalize_verdict(_pick(WORDS, "id")).alias("verdict")),
    "event_page": lambda s, d: admin.event_page(_events(s, d).drop("props"), since=NOW - 20 * 86_400, verdict="click", limit=40),
    "event_page_unknown_verdict": lambda s, d: admin.event_page(_events(s, d).drop("props"), verdict="no such kind", limit=999),
    "event_backlog": lambda s, d: admin.backlog(_events(s, d).drop("props"), F.col("kind") != "view"),
    "event_since": lambda s, d: _events(s, d).select("id", admin.since_passes(F.when(F.col("id") % 3 == 0, "x").otherwise(F.to_json(F.struct("ts_secs"))), NOW - 15 * 86_400).alias("passes")),
    "since_shapes": lambda s, d: _events(s, d).select("id", is_since_shape(F.concat(F.substring(F.lit("dhmx"), (F.col("id") % 4 + 1).cast("int"), F.lit(1)), F.col("user_id"), F.when(F.col("id") % 5 == 0, "x").otherwise(""))).alias("good")),
    "command_page": lambda s, d: admin.command_page(_commands(s, d), {"command": "cmd-1", "approval_status": "approved"}, NOW - 25 * 86_400, 30, 10),
    "command_totals": lambda s, d: admin.command_totals(_commands(s, d), {"caller_path": "/srv/c7"}),
    "command_grants": lambda s, d: access.grants(_commands(s, d).filter("approval_status = 'approved'")),
    "scope_hosts": lambda s, d: access.expanded_scopes(*_scopes(s, d)).select("owner", F.array_join("hosts", ",").alias("hosts")),
    "command_allowed": _allowed,
    "aux_rollup": lambda s, d: admin.aux_rollup(_aux(s, d), ("window", "protocol")),
    "aux_since": lambda s, d: admin.aux_rollup(_aux(s, d).filter(F.col("ts_secs") >= NOW - 5 * 86_400), ()),
    "models_since": lambda s, d: requests(s, d).filter(F.col("ts_secs") >= NOW - 5 * 86_400).groupBy("model").agg(F.count("*").alias("requests")),
    "pii_sample_rollup": lambda s, d: admin.merge_samples(
        _events(s, d).select(F.floor(F.col("ts_secs") / 86_400).alias("day"), F.concat(F.lit("u"), F.col("id") % 3).alias("upstream"), "kind", F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 16).alias("hash"), "ts_secs", F.concat(F.lit("m"), F.col("id") % 100).alias("mask"))
    ),
    "stream_counters": lambda s, d: admin.keyed_counts(
        requests(s, d), {"streams": F.col("stream"), "silent": F.col("truncated_mode") == "silent_discard", "open": F.col("truncated_mode") == "open_ended", "conversation_missing": F.col("session_id").isNull(), "failed": F.col("status") >= 500}
    ),
    "registration_view": lambda s, d: access.registration_view(_callers(s, d), "pending"),
    "caller_labels": lambda s, d: _callers(s, d).select("caller_path", access.caller_label(F.col("caller_path"), F.col("name"), F.col("allow_mode"), F.col("enabled")).alias("label")),
    "caller_health": lambda s, d: access.health(_callers(s, d), NOW),
    "caller_resolution": _resolved,
    "credential_decisions": _decided,
    "authorization_expiring": lambda s, d: identity.expiring_soon(_callers(s, d), NOW),
    "reaction_outcomes": lambda s, d: _events(s, d).select("id", access.reaction_outcome(_pick(REACTIONS, "id")).alias("outcome")),
    "approval_branches": lambda s, d: _events(s, d).select("id", access.approval_branch(_pick(REASONS, "id")).alias("branch")),
    "argument_templates": lambda s, d: table(s, d, "nation").select("n_nationkey", access.filled_arguments(F.lit("run {a} --to={b} {c} {} {"), F.create_map(F.lit("a"), F.col("n_name"), F.lit("b"), F.lit("x"))).alias("argv")),
    "header_filter": lambda s, d: _headers(s, d).select("id", F.array_join(F.array_sort(F.map_keys(bodies.end_to_end(F.col("headers")))), ",").alias("kept")),
    "header_fallback": lambda s, d: _headers(s, d).select("id", bodies.first_header(F.col("headers"), ("x-none", "session_id", "x-a")).alias("value"), bodies.valid_session(F.col("headers")["session_id"]).alias("session"), bodies.valid_request_id(F.col("headers")["x-request-id"]).alias("request")),
    "tenant_fingerprint": lambda s, d: _credentials(s, d).select("n_nationkey", bodies.joined_credentials(F.col("creds")).alias("creds"), bodies.tenant(KEY, F.col("base"), F.col("creds")).alias("tenant")),
    "conversation_keys": _conversation_keys,
    "session_digest": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", identity.session_digest(KEY, "session-v1", F.col("role"), F.col("text")).alias("session_id")),
    "stream_intent": lambda s, d: _bodies(s, d).select("id", bodies.streamed(F.col("body")).alias("stream")),
    "stream_options": lambda s, d: _bodies(s, d).select("id", jsonspan.with_put_usage_option(F.col("body")).alias("body")),
    "json_guard": lambda s, d: table(s, d, "events").select("event_id", bodies.guarded(F.col("props"), F.when(F.col("event_id") % 2 == 0, F.concat("props", F.lit("}"))).otherwise('{"k": 0}')).alias("kept")),
    "token_forms": lambda s, d: _tokens(s, d).select("event_id", bodies.has_placeholder(F.col("t")).alias("has"), F.array_join(bodies.token_forms(F.col("t")), " ").alias("forms"), bodies.registrable(F.col("t")).alias("registrable"), bodies.occurrences(F.col("t"), F.lit("__")).alias("marks")),
    "credential_tokens": lambda s, d: table(s, d, "nation").select("n_nationkey", bodies.credential_token(F.col("n_nationkey"), F.substring("n_name", 1, F.col("n_nationkey") % 8)).alias("token")),
    "request_outcomes": lambda s, d: _events(s, d).select("id", bodies.outcome(_pick(KINDS, "id"), F.when(F.col("id") % 4 == 0, 404).otherwise(200)).alias("o")).select("id", "o.status", "o.error_kind"),
    "request_protocols": lambda s, d: _events(s, d).select("id", traffic.protocol_of(_pick(PATHS, "id")).alias("protocol"), traffic.body_class(F.col("id") % 2 == 0, F.col("id") % 3, F.col("id") % 5 != 0, F.when(F.col("id") % 7 == 0, 500).otherwise(200)).alias("body")),
    "stream_models": lambda s, d: _events(s, d).select("id", traffic.stream_model(F.concat(F.when(F.col("id") % 3 == 0, '{"model":"m').when(F.col("id") % 3 == 1, '{"message":{"model":"n').otherwise('{"x":{"model":"o'), F.col("id"), F.when(F.col("id") % 3 == 0, '"}').otherwise('"}}'))).alias("model"), traffic.archived_id(F.col("props")).alias("archived")),
    "page_authority": lambda s, d: table(s, d, "pages").select("page_id", text.authority(F.col("url")).alias("authority")),
    "blanks_collapsed": lambda s, d: table(s, d, "benchmark").select("item_id", text.collapse_blanks(F.concat(F.lit(" \t"), F.col("text"), F.lit("\n\n x "))).alias("text")),
    "entry_access": lambda s, d: _events(s, d).select("id", identity.entry_allowed(F.create_map(F.lit("mail"), F.array(F.lit("user"), F.lit("password")), F.lit("git"), F.expr("cast(array() as array<string>)")), _pick(("mail", "git", "none", ""), "id"), _pick(("user", "title", ""), "user_id")).alias("allowed")),
    "luhn_checks": _luhn,
    "ipv4_checks": lambda s, d: table(s, d, "events").select("event_id", validators.ipv4_ok(_OCTETS()).alias("valid"), validators.ipv4_reserved(_OCTETS()).alias("reserved")),
}
_FORM = _pick_sql(_SHAPES, "id")
_STREAM = """CASE id % 4 WHEN 0 THEN ',"stream":true' WHEN 1 THEN ',"stream":"true"' WHEN 2 THEN ',"stream":false' ELSE '' END"""
_DIGIT = "CAST(substr(value, i, 1) AS INTEGER)"
ORACLE_SQL = {
    "verdict_words": f"""WITH {EVENTS} SELECT id, CASE WHEN w IN ('allow','allowed','pass','approved') THEN 'allow' WHEN w IN ('block','blocked','deny','rejected') THEN 'block'
      WHEN w IN ('need_approval','needapproval','pending','approve','approval') THEN 'need_approval' END AS verdict FROM (SELECT id, lower(trim({_pick_sql(WORDS, 'id')})) AS w FROM ev)""",
    "event_page": f"WITH {EVENTS}, ring AS (SELECT id, ts_secs, kind, user_id FROM ev ORDER BY id DESC LIMIT 512) SELECT * FROM ring WHERE ts_secs >= {NOW - 20 * 86_400} AND kind = 'click' ORDER BY id DESC LIMIT 40",
    "event_page_unknown_verdict": f"WITH {EVENTS} SELECT id, ts_secs, kind, user_id FROM ev ORDER BY id DESC LIMIT 200",
    "event_backlog": f"WITH {EVENTS} SELECT * FROM (SELECT id, ts_secs, kind, user_id FROM ev ORDER BY id DESC LIMIT 20) WHERE kind <> 'view'",
    "event_since": f"WITH {EVENTS} SELECT id, id % 3 = 0 OR ts_secs >= {NOW - 15 * 86_400} AS passes FROM ev",
    "since_shapes": "SELECT event_id AS id, event_id % 4 <> 3 AND event_id % 5 <> 0 AS good FROM events",
    "command_page": f"WITH {COMMANDS} SELECT * FROM commands WHERE command = 'cmd-1' AND approval_status = 'approved' AND ts_secs >= {NOW - 25 * 86_400} ORDER BY ts_secs DESC, id DESC LIMIT 30 OFFSET 10",
    "command_totals": f"WITH {COMMANDS} SELECT count(*) AS total, min(ts_secs) AS earliest FROM commands WHERE caller_path = '/srv/c7'",
    "command_grants": f"WITH {COMMANDS} SELECT DISTINCT caller_path, command, host FROM commands WHERE approval_status = 'approved'",
    "scope_hosts": f"""WITH scopes AS ({_SCOPES}), groups AS (SELECT r_name AS grp, n_name AS host FROM nation JOIN region ON n_regionkey = r_regionkey)
      SELECT owner, string_agg(h, ',' ORDER BY h) AS hosts FROM (SELECT DISTINCT owner, coalesce(host, scope) AS h FROM scopes LEFT JOIN groups ON scope = grp) GROUP BY owner""",
    "command_allowed": f"""WITH {COMMANDS}, scopes AS ({_SCOPES}), groups AS (SELECT r_name AS grp, n_name AS host FROM nation JOIN region ON n_regionkey = r_regionkey),
      rules AS (SELECT DISTINCT '/srv/c' || owner AS rc, CASE WHEN owner % 2 = 0 THEN '*' ELSE 'cmd-1' END AS rcmd, coalesce(host, scope) AS rh FROM scopes LEFT JOIN groups ON scope = grp),
      calls AS (SELECT id, caller_path, command, n_name AS host FROM commands JOIN nation ON n_nationkey = CAST(substr(host, 6) AS INTEGER))
      SELECT command, EXISTS (SELECT 1 FROM rules WHERE rc = caller_path AND rcmd IN ('*', command) AND rh = host) AS allowed, count(*) AS calls FROM calls GROUP BY 1, 2""",
    "aux_rollup": f'WITH {AUX} SELECT "window", protocol, {_SUMS} FROM aux GROUP BY 1, 2',
    "aux_since": f"WITH {AUX} SELECT {_SUMS} FROM aux WHERE ts_secs >= {NOW - 5 * 86_400}",
    "models_since": f"WITH {REQUESTS_SQL.strip()} SELECT model, count(*) AS requests FROM requests WHERE ts_secs >= {NOW - 5 * 86_400} GROUP BY 1",
    "pii_sample_rollup": f"""WITH {EVENTS} SELECT CAST(ts_secs // 86400 AS BIGINT) AS day, 'u' || id % 3 AS upstream, kind, substr(sha256(CAST(user_id AS VARCHAR)), 1, 16) AS hash, count(*) AS hits, min(ts_secs) AS first_seen, max(ts_secs) AS last_seen,
      max_by('m' || id % 100, (ts_secs, 'm' || id % 100)) AS mask FROM ev GROUP BY 1, 2, 3, 4""",
    "stream_counters": f"""WITH {REQUESTS_SQL.strip()} SELECT 'streams' AS key, count(*) FILTER (WHERE stream) AS count FROM requests UNION ALL SELECT 'silent', count(*) FILTER (WHERE truncated_mode = 'silent_discard') FROM requests
      UNION ALL SELECT 'open', count(*) FILTER (WHERE truncated_mode = 'open_ended') FROM requests UNION ALL SELECT 'conversation_missing', count(*) FILTER (WHERE session_id IS NULL) FROM requests UNION ALL SELECT 'failed', count(*) FILTER (WHERE status >= 500) FROM requests""",
    "registration_view": f"""WITH {CALLERS} SELECT caller_path, name, CASE WHEN revoked THEN '❎' WHEN enabled THEN '✅' ELSE '⏳' END AS status, coalesce(allow_mode, auto_approve, 'pending') AS mode, substr(expected_hash, 1, 8) AS hash, authorized_at,
      CASE WHEN authorized_at IS NOT NULL THEN authorized_ttl_secs END AS ttl_secs FROM callers""",
    "caller_labels": f"""WITH {CALLERS} SELECT caller_path, name || '（' || caller_path || '）' || CASE WHEN enabled THEN '' ELSE '（未注册）' END || CASE WHEN allow_mode IS NOT NULL THEN ' · ' || allow_mode ELSE '' END AS label FROM callers""",
    "caller_health": f"""WITH {CALLERS} SELECT count(*) FILTER (WHERE NOT enabled AND NOT revoked) AS pending, count(*) FILTER (WHERE enabled AND NOT revoked) AS enabled, count(*) FILTER (WHERE revoked) AS revoked,
      count(*) FILTER (WHERE enabled AND NOT revoked AND authorized_ttl_secs > 0 AND authorized_at + authorized_ttl_secs > {NOW} AND authorized_at + authorized_ttl_secs <= {NOW + 86_400}) AS expiring FROM callers""",
    "caller_resolution": f"WITH {CALLS} SELECT * FROM resolved",
    "credential_decisions": f"""WITH {CALLS}, d AS (SELECT outcome, coalesce(allow_mode, auto_approve, 'pending') AS mode, CASE WHEN authorized_ttl_secs > 0 THEN authorized_at + authorized_ttl_secs END AS ends FROM resolved r LEFT JOIN callers c ON r.entry_path = c.caller_path)
      SELECT outcome, CASE WHEN outcome = 'revoked' THEN 'deny' WHEN outcome IN ('unknown', 'mismatch') THEN 'pending' WHEN mode = 'deny' THEN 'deny' WHEN ends <= {NOW} THEN 'pending' ELSE mode END AS decision, count(*) AS calls FROM d GROUP BY 1, 2""",
    "authorization_expiring": f"""WITH {CALLERS} SELECT caller_path, authorized_at + authorized_ttl_secs AS expires_at FROM callers
      WHERE enabled AND NOT revoked AND authorized_ttl_secs > 0 AND authorized_at + authorized_ttl_secs > {NOW} AND authorized_at + authorized_ttl_secs <= {NOW + 86_400}""",
    "reaction_outcomes": f"SELECT event_id AS id, nullif({_pick_sql(('approve_always', 'approve_always', 'demote_manual', 'disable', '', ''), 'event_id')}, '') AS outcome FROM events",
    "approval_branches": f"SELECT event_id AS id, {_pick_sql(('error', 'revoke', 'credential', 'hash_change', 'register', 'credential', 'command', 'audit', 'unknown', 'register', 'error', 'revoke'), 'event_id')} AS branch FROM events",
    "argument_templates": "SELECT n_nationkey, 'run ' || n_name || ' --to=x {c} {} {' AS argv FROM nation",
    "header_filter": "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'accept,content-type,session_id,x-request-id' ELSE 'accept,content-type,session_id,x-a,x-request-id' END AS kept FROM events",
    "header_fallback": r"SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 's' || event_id WHEN 1 THEN CAST(event_id AS VARCHAR) ELSE 'a' || chr(9) || 'b' END AS value, event_id % 3 <> 2 AS session, event_id % 4 <> 0 AS request FROM events",
    "tenant_fingerprint": f"SELECT n_nationkey, {_CREDS} AS creds, " + hmac_sql(KEY, f"'https://h' || n_regionkey || chr(31) || {_CREDS}") + " AS tenant FROM nation",
    "conversation_keys": f"""WITH t AS (SELECT conv_id, min_by(text, turn) FILTER (WHERE role = 'system') AS system_text, min_by(text, turn) FILTER (WHERE role = 'user') AS first_user_text FROM conversations GROUP BY conv_id),
      p AS (SELECT conv_id, CASE WHEN conv_id % 11 = 0 AND first_user_text IS NOT NULL THEN {_PREFIX} END AS prefix FROM t),
      c AS (SELECT conv_id, prefix, CASE WHEN conv_id % 5 = 0 THEN 'header' || chr(31) || 'h' || conv_id WHEN conv_id % 3 <> 1 AND conv_id % 4 = 0 THEN 'cache' || chr(31) || 'c' || conv_id
        WHEN conv_id % 3 = 2 AND conv_id % 7 = 0 THEN 'earlier' || chr(31) || 'e' || conv_id WHEN prefix IS NOT NULL THEN 'prefix' || chr(31) || prefix END AS chosen FROM p)
      SELECT conv_id, CASE WHEN chosen IS NOT NULL THEN {hmac_sql(KEY, "'tenant' || chr(31) || chosen")} END AS conversation, sha256(prefix) AS prefix FROM c""",
    "session_digest": f"SELECT conv_id, turn, CASE WHEN text IS NOT NULL THEN substr({hmac_sql(KEY, "'session-v1' || chr(31) || role || chr(31) || text")}, 1, 16) END AS session_id FROM conversations",
    "stream_intent": "SELECT event_id AS id, event_id % 4 = 0 AS stream FROM events",
    "stream_options": f"""WITH {EVENTS} SELECT id, '{{"model":"m' || id || '"' || {_STREAM} || {_pick_sql(_WITH, 'id')} || '}}' AS body FROM ev""",
    "json_guard": """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props ELSE '{"k": 0}' END AS kept FROM events""",
    "token_forms": f"""SELECT event_id, event_id % 3 <> 2 AS has, CASE event_id % 3 WHEN 0 THEN '__PII_' || event_id || '_0a1b2c3d__' WHEN 1 THEN printf('__CRED_%06d__', event_id) ELSE '__CRED_12__' END AS forms, false AS registrable,
      CAST((length({_TOKEN_TEXT}) - length(replace({_TOKEN_TEXT}, '__', ''))) // 2 AS BIGINT) AS marks FROM events""",
    "credential_tokens": "SELECT n_nationkey, CASE WHEN length(v) < 4 THEN v ELSE printf('__CRED_%06d__', n_nationkey) END AS token FROM (SELECT n_nationkey, substr(n_name, 1, n_nationkey % 8) AS v FROM nation)",
    "request_outcomes": f"""SELECT id, CAST(CASE WHEN k IN ('no_upstream','pii_unavailable','empty_body','non_json','oversize') THEN 502 WHEN k = 'bad_request' THEN 400 ELSE st END AS INTEGER) AS status,
      CASE WHEN k NOT IN ('ok','passthrough') THEN k WHEN st >= 400 THEN 'upstream_status' END AS error_kind FROM (SELECT event_id AS id, {_pick_sql(KINDS, 'event_id')} AS k, CASE WHEN event_id % 4 = 0 THEN 404 ELSE 200 END AS st FROM events)""",
    "request_protocols": f"""SELECT event_id AS id, {_pick_sql(('chat', 'anthropic', 'anthropic', 'passthrough', 'responses', 'responses', 'passthrough', 'passthrough'), 'event_id')} AS protocol,
      CASE WHEN event_id % 2 = 1 THEN 'non_dialog_exempt' WHEN event_id % 7 = 0 THEN 'passthrough_error_status' WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN 'non_stream_to_502' ELSE 'passthrough_ok' END AS body FROM events""",
    "stream_models": "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'm' || event_id WHEN 1 THEN 'n' || event_id END AS model, 'unknown_' || substr(sha256(props), 1, 8) AS archived FROM events",
    "page_authority": "SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)', 1) AS authority FROM pages",
    "blanks_collapsed": r"SELECT item_id, trim(regexp_replace(' ' || chr(9) || text || chr(10) || chr(10) || ' x ', '\s+', ' ', 'g')) AS text FROM benchmark",
    "entry_access": "SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN user_id % 3 <> 1 WHEN 1 THEN true ELSE false END AS allowed FROM events",
    "luhn_checks": f"""WITH v AS (SELECT o_orderkey, '4' || lpad(CAST(o_orderkey * 7919 AS VARCHAR), 15, '1') AS value FROM orders)
      SELECT o_orderkey, value, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN {_DIGIT} WHEN {_DIGIT} * 2 > 9 THEN {_DIGIT} * 2 - 9 ELSE {_DIGIT} * 2 END)) % 10 = 0 AS luhn FROM v""",
    "ipv4_checks": """SELECT event_id, a < 256 AS valid, a < 256 AND (a IN (10, 127, 0) OR a >= 224 OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 198 AND b IN (18, 19)) OR (a = 172 AND (b BETWEEN 16 AND 31 OR CAST(b AS VARCHAR) LIKE '2%'))
      OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) OR (a = 192 AND b = 88 AND c = 99)) AS reserved
      FROM (SELECT event_id, user_id % 260 AS a, event_id % 256 AS b, event_id % 10 AS c FROM events)""",
}
