"""Queries over approvals, registrations, continued conversations, name tables and wide numbers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dictionary, ledger
from ..sources.driver_tables import REQUESTS_SQL, requests, table

_LOG = f"WITH {REQUESTS_SQL.strip()}"
DAY = 86_400


def _ops(s, d, ops, node):
    """Events as operations, by a hash of their number that SQL can repeat."""
    e = requests(s, d)
    turn = (F.col("id") * 7_919 % 1_009 % len(ops)).cast("int") + 1
    return e.select(F.col(node).cast("string").alias("node"), F.col("id").alias("seq"), F.col("ts_secs").alias("ts"), F.element_at(F.array(*[F.lit(o) for o in ops]), turn).alias("op"), F.col("prompt_tokens").cast("string").alias("key"))


APPROVALS = ("ask", "ask", "approve", "deny", "ask", "approve", "deny", "lock", "ask", "forget", "approve", "ask", "clear", "deny", "ask")
DECISIONS = ("begin", "begin", "approve", "begin", "deny", "begin", "consume", "begin", "time_out")
CHANGES = ("register", "register", "enable", "register", "revoke", "register", "hash_change", "mode", "window", "disable", "register", "revoke")


def _settled(s, d):
    e = _ops(s, d, APPROVALS, "model")
    return ledger.settled_approvals(e.withColumn("id", F.when(~F.col("op").isin("lock", "clear", "forget"), F.col("key"))))


def _continued(s, d):
    e = requests(s, d)
    said = e.filter("session_id is not null").select(F.col("protocol").alias("tenant"), F.concat(F.lit("resp-"), F.col("prompt_tokens") % 50).alias("response_id"), F.col("session_id").alias("conversation"), F.col("ts_secs").alias("ts"))
    asked = e.select(F.col("protocol").alias("tenant"), "id", F.when(F.col("id") % 9 > 0, F.concat(F.lit("resp-"), F.col("completion_tokens") % 60)).alias("previous_id"), F.col("ts_secs").alias("ts"))
    return ledger.continued_responses(said, asked, 7 * DAY)


def _registry(s, d):
    e = _ops(s, d, CHANGES, "model").withColumnsRenamed({"key": "path"})
    name = F.when(F.col("seq") % 4 > 0, F.concat(F.lit("n"), (F.col("seq") * 31 % 997).cast("string")))
    rows = e.select("seq", "op", "path", name.alias("name"), F.sha2(F.col("seq").cast("string"), 256).alias("hash"), F.when(F.col("seq") % 2 == 0, "allow").alias("mode"), (F.col("seq") % 100).alias("ttl"), "ts")
    return ledger.registry_by_two_keys(rows)


def _names(s, d):
    docs = table(s, d, "documents")
    word = F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z0-9]{4,}", 0)
    return docs, docs.select(word.alias("name")).filter("name <> ''").distinct().select("name", F.lit(None).cast("string").alias("value"), F.lit("org").alias("kind"))


def _hits(most):
    def run(s, d):
        docs, names = _names(s, d)
        found = dictionary.table_hits(docs, "doc_id", "text", names, most_bytes=most)
        listed = F.array_sort(F.array_distinct("hits.name"))
        return found.select(F.col("id").alias("doc_id"), F.size("hits").cast("bigint").alias("hits"), F.sha2(F.array_join(listed, " "), 256).alias("names"))

    return run


def _vault(most):
    def run(s, d):
        vault = table(s, d, "customer").select(F.col("c_name").alias("name"), F.format_string("__CRED_%06d__", "c_custkey").alias("value"))
        texts = table(s, d, "orders").select("o_orderkey", F.concat(F.lit("order "), "o_orderkey", F.lit(" of "), F.format_string("Customer#%09d", "o_custkey"), F.lit("7, not Customer#0 (Customer#"), F.format_string("%09d", "o_custkey"), F.lit(")")).alias("text"))
        return dictionary.table_replaced(texts, "o_orderkey", "text", vault, most).withColumnsRenamed({"id": "o_orderkey"})

    return run


def _buckets(s, d):
    e = table(s, d, "events")
    wide = (F.col("event_id").cast("decimal(18,0)") * F.lit("18446744073709551").cast("decimal(17,0)") + F.col("user_id").cast("decimal(18,0)")).cast("decimal(38,0)")
    small = F.col("event_id").cast("decimal(20,0)") * 40_003
    raw = F.when(F.col("event_id") % 3 == 0, small).otherwise(F.pmod(wide, F.lit(str(1 << 64)).cast("decimal(38,0)"))).cast("decimal(20,0)")
    return e.select("event_id", ledger.tool_bucket(raw).alias("bucket"), ledger.chat_bucket(F.col("user_id").cast("decimal(20,0)") * 900, raw).alias("chat"))


QUERIES = {
    "settled_approvals": _settled,
    "continued_responses": _continued,
    "decision_outcomes": lambda s, d: ledger.decision_outcomes(_ops(s, d, DECISIONS, "protocol"), 40, 7_200),
    "registry_two_keys": _registry,
    "name_table_hits": _hits(dictionary.MOST_BYTES),
    "name_table_hits_joined": _hits(0),
    "vault_replaced": _vault(dictionary.MOST_BYTES),
    "vault_replaced_joined": _vault(0),
    "tool_buckets": _buckets,
}


def _ops_sql(ops, node):
    listed = ", ".join(f"'{o}'" for o in ops)
    return f"{_LOG}, e AS (SELECT CAST({node} AS VARCHAR) AS node, id AS seq, ts_secs AS ts, list_extract([{listed}], id * 7919 % 1009 % {len(ops)} + 1) AS op, CAST(prompt_tokens AS VARCHAR) AS key FROM requests)"


_HITS_SQL = r"""WITH names AS (SELECT DISTINCT regexp_extract(coalesce(text, ''), '[A-Za-z0-9]{4,}') AS name FROM documents WHERE regexp_extract(coalesce(text, ''), '[A-Za-z0-9]{4,}') <> ''),
  words AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS name FROM documents),
  hits AS (SELECT doc_id, count(*) AS hits, array_to_string(list_sort(list_distinct(list(name))), ' ') AS names FROM words SEMI JOIN names USING (name) GROUP BY doc_id)
  SELECT d.doc_id, coalesce(hits, 0) AS hits, sha256(coalesce(names, '')) AS names FROM documents AS d LEFT JOIN hits USING (doc_id)"""
_VAULT_SQL = "SELECT o_orderkey, 'order ' || o_orderkey || ' of ' || printf('__CRED_%06d__', o_custkey) || '7, not Customer#0 (' || printf('__CRED_%06d__', o_custkey) || ')' AS replaced FROM orders"
_TWO64 = "18446744073709551616::UHUGEINT"


def _digest(x: str) -> str:
    """splitmix64 of a SQL expression over ``%s``, as column a; each step is a subquery, so that nothing stands twice."""
    out = f"SELECT *, ({x}::UHUGEINT + 11400714819323198485::UHUGEINT) %% {_TWO64} AS a FROM %s"
    for by, c in ((30, "13787848793156543929"), (27, "10723151780598845931")):
        out = f"SELECT * REPLACE ((xor(a::UBIGINT, a::UBIGINT >> {by})::UHUGEINT * {c}::UHUGEINT) %% {_TWO64} AS a) FROM ({out})"
    return f"SELECT * REPLACE (xor(a::UBIGINT, a::UBIGINT >> 31)::UHUGEINT AS a) FROM ({out})"


_RAW = f"""SELECT event_id, user_id::UHUGEINT * 900 AS c, CASE WHEN event_id % 3 = 0 THEN event_id::UHUGEINT * 40003 ELSE (event_id::UHUGEINT * 18446744073709551::UHUGEINT + user_id::UHUGEINT) % {_TWO64} END AS i FROM events"""
_FIRST = _digest("i") % f"({_RAW})"
_ROTATED = f"xor(((c * 131072) %% {_TWO64} + c // 140737488355328)::UBIGINT, ((i * 11400714819323198485::UHUGEINT) %% {_TWO64})::UBIGINT)"
_SECOND = _digest(_ROTATED) % f"(SELECT * RENAME (a AS h) FROM ({_FIRST}))"
_THIRD = _digest("b") % f"(SELECT * RENAME (a AS b) FROM ({_SECOND}))"
ORACLE_SQL = {
    "settled_approvals": f"""{_ops_sql(APPROVALS, "model")}, a AS (SELECT node, key AS id, seq FROM e WHERE op = 'ask'),
      own AS (SELECT a.node, a.id, a.seq, min(d.seq) AS d_at, arg_min(d.op, d.seq) AS d_op FROM a JOIN e AS d ON d.node = a.node AND d.key = a.id AND d.op IN ('approve', 'deny') AND d.seq > a.seq GROUP BY ALL),
      bulk AS (SELECT a.node, a.id, a.seq, min(d.seq) AS l_at FROM a JOIN e AS d ON d.node = a.node AND d.op IN ('lock', 'clear') AND d.seq > a.seq GROUP BY ALL),
      s AS (SELECT a.*, CASE WHEN d_at IS NOT NULL AND (l_at IS NULL OR d_at < l_at) THEN CASE d_op WHEN 'approve' THEN 'approved' ELSE 'denied' END WHEN l_at IS NOT NULL THEN 'locked' ELSE 'pending' END AS outcome,
        CASE WHEN d_at IS NOT NULL AND (l_at IS NULL OR d_at < l_at) THEN d_at ELSE l_at END AS settled_at FROM a LEFT JOIN own USING (node, id, seq) LEFT JOIN bulk USING (node, id, seq))
      SELECT s.node, s.id, s.seq, outcome, settled_at, min(f.seq) AS gone_at FROM s LEFT JOIN e AS f ON f.node = s.node AND ((f.op IN ('forget', 'clear') AND f.seq > settled_at) OR (f.op = 'clear' AND f.seq = settled_at)) GROUP BY ALL""",
    "continued_responses": f"""{_LOG}, r AS (SELECT protocol AS tenant, 'resp-' || prompt_tokens % 50 AS response_id, ts_secs AS ts, max(session_id) AS conversation FROM requests WHERE session_id IS NOT NULL GROUP BY ALL),
      q AS (SELECT protocol AS tenant, id, CASE WHEN id % 9 > 0 THEN 'resp-' || completion_tokens % 60 END AS previous_id, ts_secs AS ts FROM requests)
      SELECT q.tenant, q.id, q.previous_id, CASE WHEN q.ts - r.ts <= {7 * DAY} THEN r.conversation END AS conversation FROM q ASOF LEFT JOIN r ON q.tenant = r.tenant AND q.previous_id = r.response_id AND q.ts > r.ts""",
    "name_table_hits": _HITS_SQL,
    "name_table_hits_joined": _HITS_SQL,
    "vault_replaced": _VAULT_SQL,
    "vault_replaced_joined": _VAULT_SQL,
    "tool_buckets": f"""SELECT event_id, CAST(CASE WHEN i < 4278190080 THEN i ELSE 4278190080 + h % 256 END AS BIGINT) AS bucket,
      CAST(CASE WHEN c < 65280 AND i < 65536 THEN c * 65536 + i ELSE 4278190080 + a % 256 END AS BIGINT) AS chat FROM ({_THIRD})""",
}
