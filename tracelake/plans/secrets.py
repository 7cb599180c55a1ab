"""Queries over credentials, JSON bodies, users' rules and the audit log's texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pii, secrets
from ..sources.driver_tables import table
from . import redaction
from .values import literal

VAULT = {f"Customer#{i:09d}": f"__CRED_{i:06d}__" for i in range(1, 201)}
RULES = [("pair", "[0-9]{3}-[0-9]{4}"), ("topic", "license|model|data"), ("late", "model")]
NAMES = [("the", "term"), ("and", "term"), ("license", "term"), ("de", "term")]
ENTRIES = ('{"mail":["user","password"],"git":"url"}', '["a","b","a"]', "one", '{"x":[]}')
MODES = ("auto", "manual", " TRUE", "false", "Deny", "pending", "other", "")


def _texts(s, d):
    n = F.col("c_custkey")
    return table(s, d, "customer").select("c_custkey", F.concat(F.lit("from "), "c_name", F.lit(" to "), "c_name", F.lit("9, key sk-abcdef"), n, F.lit(" mail a"), n, F.lit("@ex.org; password = p"), n, F.lit(", Bearer t"), n, F.lit("\t13800138000")).alias("t"))


def _tokens(s, d):
    n = F.col("c_custkey")
    token = F.format_string("__CRED_%06d__", n)
    vault = F.create_map(token, F.col("c_name"))
    text = F.concat(F.lit("a "), token, F.lit(" b __CRED_999999__"))
    return table(s, d, "customer").select("c_custkey", secrets.restore_credentials(text, vault, F.when(n % 2 == 0, F.array(token)).otherwise(F.array(F.lit("__CRED_000000__")))).alias("t"))


def _json(s, d):
    inner = F.to_json(F.struct(F.col("text").alias("t")))
    rows = table(s, d, "documents").select("doc_id", F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.coalesce("text", F.lit("")).alias("content"))).alias("messages"), inner.alias("inner"))).alias("body"))
    made = secrets.redact_json(rows, redaction.SALT, "doc_id")
    return made.select("doc_id", F.get_json_object("redacted", "$.messages[0].content").alias("redacted"))


def _pick(words, by):
    return F.element_at(F.array(*[F.lit(w) for w in words]), (by % len(words) + 1).cast("int"))


def _entries(s, d):
    i = F.col("event_id")
    made = F.map_entries(secrets.registered_entries(_pick(ENTRIES, i)))
    line = F.transform(made, lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], "+")))
    return table(s, d, "events").select("event_id", F.array_join(F.array_sort(line), ",").alias("entries"), secrets.parsed_mode(_pick(MODES, i)).alias("mode"))


def _custom(s, d):
    hits = table(s, d, "documents").select("doc_id", F.explode(pii.custom_hits(F.coalesce("text", F.lit("")), RULES)).alias("h"))
    return hits.groupBy("doc_id", F.col("h.kind").alias("kind")).agg(F.count("*").alias("hits"))


def _named(s, d):
    hits = table(s, d, "documents").select("doc_id", F.explode(pii.dictionary_hits(F.coalesce("text", F.lit("")), NAMES)).alias("h"))
    return hits.groupBy("doc_id", F.col("h.value").alias("name")).agg(F.count("*").alias("hits"))


QUERIES = {
    "log_texts": lambda s, d: _texts(s, d).select("c_custkey", secrets.for_log(F.col("t")).alias("t")),
    "credentials_replaced": lambda s, d: _texts(s, d).select("c_custkey", secrets.replace_credentials(F.col("t"), VAULT).alias("t")),
    "credentials_restored": _tokens,
    "json_redacted": _json,
    "registered_entries": _entries,
    "custom_rule_hits": _custom,
    "dictionary_names": _named,
}
_TEXT = "'from ' || {a} || ' to ' || {b} || '9, key {k} mail {m}; password = {p}, Bearer {t}' || {end}"
_SHOWN = _TEXT.format(a="c_name", b="c_name", k="[REDACTED:secret]", m="[REDACTED:email]", p="[REDACTED:*]", t="[REDACTED:bearer]", end="''")
_TOKEN = "CASE WHEN c_custkey BETWEEN 1 AND 200 THEN printf('__CRED_%06d__', c_custkey) ELSE c_name END"
ORACLE_SQL = {
    # The tab goes first, so that the number after it belongs to the bearer.
    "log_texts": f"SELECT c_custkey, {_SHOWN} AS t FROM customer",
    "credentials_replaced": f"SELECT c_custkey, 'from ' || {_TOKEN} || ' to ' || {_TOKEN} || '9, key sk-abcdef' || c_custkey || ' mail a' || c_custkey || '@ex.org; password = p' || c_custkey || ', Bearer t' || c_custkey || chr(9) || '13800138000' AS t FROM customer",
    "credentials_restored": "SELECT c_custkey, 'a ' || CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE printf('__CRED_%06d__', c_custkey) END || ' b __CRED_999999__' AS t FROM customer",
    "json_redacted": redaction.ORACLE_SQL["redact_documents"].replace("CASE WHEN ts IS NULL THEN text", "CASE WHEN ts IS NULL THEN coalesce(text, '')"),
    "registered_entries": f"""SELECT event_id, list_extract(['git:url,mail:user+password', 'a:,b:', 'one:', 'x:'], CAST(event_id % 4 + 1 AS BIGINT)) AS entries,
      nullif(list_extract(['allow', 'pending', 'allow', 'deny', 'deny', 'pending', '', ''], CAST(event_id % {len(MODES)} + 1 AS BIGINT)), '') AS mode FROM events""",
    "custom_rule_hits": f"""SELECT doc_id, kind, count(*) AS hits FROM (SELECT doc_id, 'pair' AS kind, unnest(regexp_extract_all(text, {literal(RULES[0][1])})) FROM documents
      UNION ALL SELECT doc_id, 'topic', unnest(regexp_extract_all(text, {literal(RULES[1][1])})) FROM documents) GROUP BY 1, 2""",
    "dictionary_names": r"""SELECT doc_id, name, count(*) AS hits FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '([^0-9A-Za-z])', '\1\1', 'g'), '(?:^|[^0-9A-Za-z])(the|and|license|de)(?:[^0-9A-Za-z]|$)', 1)) AS name FROM documents) GROUP BY 1, 2""",
}
