"""Queries over rate limits, registry events, approvals and bounded lists, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lookup import dictionary_hits, execution_key, execution_state
from ..operators import folds
from ..sources.driver_tables import REQUESTS_SQL, requests, table

WEEK = 604_800
OPS = {"signup": "register", "view": "approve", "click": "hash_change", "purchase": "approve_always", "error": "revoke"}
NAMES = ["the", "there", "data", "model", "license", "ing", "tion", "and", "example.org"]
KNOWN = ("chat", "anthropic")


def _operations(s, d):
    kind = F.col("event_type")
    op = F.coalesce(*[F.when(kind == k, v) for k, v in OPS.items()])
    ts = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(s, d, "events").select(F.col("user_id").alias("caller"), F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("hash"), ts.alias("ts"))


def _decisions(s, d):
    e = _operations(s, d).select(F.col("caller").alias("key"), "ts", F.col("seq").alias("id"), "op")
    return folds.first_decisions(e.filter("op = 'approve_always'"), e.filter("op in ('hash_change', 'revoke')").withColumn("approved", F.col("op") == "hash_change"), 86_400)


def _bound(s, d):
    n = F.col("n_nationkey")
    downstreams = table(s, d, "nation").select(F.col("n_name").alias("name"), F.array(F.concat(F.lit("/srv/"), n), F.concat(F.lit("/srv/"), (n + 5) % 25)).alias("callers"))
    calls = table(s, d, "events").select("event_id", F.concat(F.lit("/srv/"), F.col("event_id") % 30).alias("caller_path"))
    return folds.bind_downstream(calls, downstreams).groupBy("caller_path", "downstream").agg(F.count("*").alias("calls"))


def _states(s, d):
    i = F.col("event_id")
    decision = F.when(i % 4 == 0, "denied").when(i % 4 != 1, "approved")
    exit_code, timed_out = F.when(i % 3 == 0, 0).when(i % 3 == 1, 3), F.when(i % 7 == 0, F.lit(True)).when(i % 7 == 1, F.lit(False))
    return table(s, d, "events").select("event_id", execution_state(decision, exit_code, timed_out).alias("state"))


QUERIES = {
    "rate_limit_sliding": lambda s, d: folds.sliding_admit(requests(s, d), "prompt_tokens", "ts_secs", "id", 10, WEEK),
    "registry_state": lambda s, d: folds.registry_state(_operations(s, d)),
    "first_decisions": _decisions,
    "previous_response_link": lambda s, d: folds.previous_link(requests(s, d), "session_id", ("ts_secs", "id"), "protocol = 'responses'"),
    "sequence_cursor": lambda s, d: folds.running_cursor(requests(s, d), "session_id", ("ts_secs", "id"), "completion_tokens"),
    "first_notifications": lambda s, d: folds.first_notifications(requests(s, d), "model", "protocol"),
    "counts_with_other": lambda s, d: folds.counts_with_other(requests(s, d), "protocol", KNOWN),
    "downstream_binding": _bound,
    "dictionary_hits": lambda s, d: table(s, d, "documents").select(F.explode(dictionary_hits(F.col("text"), NAMES)).alias("name")).groupBy("name").agg(F.count("*").alias("hits")),
    "execution_key": lambda s, d: table(s, d, "events").select("event_id", execution_key(F.col("event_type"), F.col("user_id"), F.col("props")).alias("execution_key")),
    "execution_state": _states,
}
_LOG = f"WITH {REQUESTS_SQL.strip()}"
_OPS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OPS.items()) + " END"
_EVENTS_SQL = f"e AS (SELECT user_id AS k, event_id AS id, {_OPS_SQL} AS op, 'h' || event_id AS hash, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)"
ORACLE_SQL = {
    "rate_limit_sliding": f"""WITH RECURSIVE {REQUESTS_SQL.strip()},
      h AS (SELECT id, prompt_tokens AS k, ts_secs AS t, row_number() OVER (PARTITION BY prompt_tokens ORDER BY ts_secs, id) AS i FROM requests),
      w AS (SELECT id, k, t, i, [t] AS kept, true AS admitted, CAST(0 AS BIGINT) AS retry FROM h WHERE i = 1
        UNION ALL
        SELECT id, k, t, i, CASE WHEN len(live) < 10 THEN list_append(live, t) ELSE live END, len(live) < 10, CAST(CASE WHEN len(live) < 10 THEN 0 ELSE greatest(1, {WEEK} - (t - live[1])) END AS BIGINT)
        FROM (SELECT h.*, list_filter(w.kept, lambda x: h.t - x < {WEEK}) AS live FROM w JOIN h ON h.k = w.k AND h.i = w.i + 1))
      SELECT id, k AS key, admitted, retry AS retry_secs FROM w""",
    "registry_state": f"""WITH RECURSIVE {_EVENTS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id) AS i FROM e),
      s AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS i, NULL::VARCHAR AS hash, NULL::VARCHAR AS old, NULL::BIGINT AS until, NULL::BOOLEAN AS enabled, NULL::BOOLEAN AS revoked, NULL::VARCHAR AS mode,
          NULL::BIGINT AS since, CAST(0 AS BIGINT) AS conflicts, CAST(0 AS BIGINT) AS refused FROM e
        UNION ALL
        SELECT k, i, CASE WHEN fresh OR changed THEN eh ELSE hash END, CASE WHEN fresh THEN NULL WHEN changed THEN hash ELSE old END, CASE WHEN fresh THEN NULL WHEN changed THEN t + 3600 ELSE until END,
          CASE WHEN fresh OR ended THEN false WHEN yes THEN true ELSE enabled END, CASE WHEN fresh THEN false WHEN ended THEN true ELSE revoked END,
          CASE WHEN fresh THEN NULL WHEN yes AND op = 'approve_always' THEN 'allow' ELSE mode END, CASE WHEN fresh THEN NULL WHEN yes THEN t ELSE since END,
          conflicts + CASE WHEN active AND op = 'register' THEN 1 ELSE 0 END, refused + CASE WHEN NOT active AND op <> 'register' THEN 1 ELSE 0 END
        FROM (SELECT *, NOT active AND op = 'register' AS fresh, active AND op = 'hash_change' AS changed, active AND op = 'revoke' AS ended, active AND op IN ('approve', 'approve_always') AS yes
          FROM (SELECT s.k, o.i, o.op, o.t, o.hash AS eh, s.hash, s.old, s.until, s.enabled, s.revoked, s.mode, s.since, s.conflicts, s.refused, coalesce(NOT s.revoked, false) AS active
            FROM s JOIN o ON o.k = s.k AND o.i = s.i + 1)))
      SELECT k AS caller, hash AS expected_hash, old AS old_hash, until AS old_hash_expires_at, enabled, revoked, mode AS allow_mode, since AS authorized_at, conflicts, refused
      FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1""",
    "first_decisions": f"""WITH {_EVENTS_SQL}, q AS (SELECT *, row_number() OVER (ORDER BY t, id) AS place FROM e),
      n AS (SELECT a.id, a.k, a.t, arg_min(b.t, b.place) AS bt, arg_min(b.op, b.place) AS bop FROM q a LEFT JOIN q b ON a.k = b.k AND b.op IN ('hash_change', 'revoke') AND b.place > a.place
        WHERE a.op = 'approve_always' GROUP BY a.id, a.k, a.t)
      SELECT id, k AS key, CASE WHEN bt IS NULL OR bt - t > 86400 THEN 'timeout' WHEN bop = 'hash_change' THEN 'approved' ELSE 'denied' END AS state, CASE WHEN bt - t <= 86400 THEN bt - t END AS waited_secs FROM n""",
    "previous_response_link": f"""{_LOG} SELECT id, session_id, last_value(CASE WHEN protocol = 'responses' THEN id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts_secs, id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_id FROM requests WHERE session_id IS NOT NULL""",
    "sequence_cursor": f"{_LOG} SELECT id, session_id, max(completion_tokens) OVER (PARTITION BY session_id ORDER BY ts_secs, id ROWS UNBOUNDED PRECEDING) AS cursor FROM requests",
    "first_notifications": f"{_LOG} SELECT model, protocol, ts_secs, id FROM requests QUALIFY row_number() OVER (PARTITION BY model, protocol ORDER BY ts_secs, id) = 1",
    "counts_with_other": f"{_LOG} SELECT CASE WHEN protocol IN ('chat', 'anthropic') THEN protocol ELSE 'other' END AS name, count(*) AS n FROM requests GROUP BY 1",
    "downstream_binding": """WITH c AS (SELECT '/srv/' || event_id % 30 AS p FROM events), d AS (SELECT n_name AS name, '/srv/' || n_nationkey AS q FROM nation UNION ALL SELECT n_name, '/srv/' || (n_nationkey + 5) % 25 FROM nation),
      b AS (SELECT q, min(name) AS downstream FROM d GROUP BY 1) SELECT p AS caller_path, downstream, count(*) AS calls FROM c LEFT JOIN b ON p = q GROUP BY 1, 2""",
    "dictionary_hits": """SELECT name, count(*) AS hits FROM (SELECT unnest(regexp_extract_all(text, 'there|the|data|model|license|ing|tion|and|example\\.org')) AS name FROM documents) GROUP BY name""",
    "execution_key": "SELECT event_id, sha256(encode(event_type) || '\\x00'::BLOB || encode(CAST(user_id AS VARCHAR)) || '\\x00'::BLOB || encode(props) || '\\x00'::BLOB) AS execution_key FROM events",
    "execution_state": """SELECT event_id, CASE WHEN event_id % 4 < 2 THEN 'not_run' WHEN event_id % 7 = 0 THEN 'timeout' WHEN event_id % 3 = 0 THEN 'executed' ELSE 'failed' END AS state FROM events""",
}
