"""Queries over personal data and text functions, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import masks, text
from ..functions.text import SUMMARY_RULES
from ..operators import pii
from ..sources.driver_tables import table
from .values import hmac_sql, literal

SALT = b"fixed salt of the driver queries"
KINDS = ("phone", "email", "bank_card", "bankcard", "bank", "id_card", "ipv4", "ipv6", "api_key", "apikey", "name")
#: (what a stream has cut off, what is left of it)
PARTIALS = (("see __PII_1_", "see "), ("__PII_1_0a1b2c3d__", "__PII_1_0a1b2c3d__"), ("__PIXEL", "__PIXEL"), ("a __PI", "a "), ("__CRED_000123__PI", "__CRED_000123__PI"), ("__PII_12_ab, then", ", then"), ("plain", "plain"))
_N = "length(value)"
_ENDS = lambda a, b: f"(substr(value, 1, {a}) || '****' || right(value, {b}))"
_SHORT = f"CASE WHEN {_N} < 2 THEN '***' WHEN {_N} < 6 THEN {_ENDS(1, 1)} ELSE {_ENDS(3, 3)} END"
_EMAIL = "CASE WHEN strpos(substr(value, strpos(value, '@') + 1), '.') > 0 AND split_part(value, '.', -1) <> '' THEN '***@***.' || split_part(value, '.', -1) ELSE '***@***' END"
_V4 = "WHEN len(string_split(value, '.')) = 4 THEN split_part(value, '.', 1) || '.' || split_part(value, '.', 2) || '.**.**'"
_CARD = "'**** **** **** ' || right(value, 4)"
_BRIEF = f"CASE WHEN {_N} >= 2 THEN {_ENDS(1, 1)} ELSE '***' END"
MASK_MODEL_SQL = f"""substr(CASE WHEN value = '' THEN '***' WHEN kind = 'phone' AND {_N} >= 7 THEN {_ENDS(3, 4)} WHEN kind = 'email' AND contains(value, '@') THEN {_EMAIL}
  WHEN kind IN ('bank_card', 'bankcard', 'id_card') AND {_N} >= 4 THEN {_CARD} WHEN kind = 'ipv4' THEN CASE {_V4} WHEN {_N} >= 8 THEN {_ENDS(4, 4)} ELSE {_BRIEF} END
  WHEN kind IN ('ipv6', 'api_key', 'apikey') AND {_N} >= 8 THEN {_ENDS(4, 4)} ELSE {_SHORT} END, 1, 64)"""
MASK_SAMPLE_SQL = f"""substr(CASE WHEN value = '' THEN '***' WHEN kind = 'phone' AND {_N} >= 7 THEN {_ENDS(3, 4)} WHEN kind = 'email' AND contains(value, '@') THEN {_EMAIL}
  WHEN kind IN ('bank', 'bank_card') THEN CASE WHEN {_N} >= 4 THEN {_CARD} ELSE {_BRIEF} END WHEN kind = 'ipv4' THEN CASE {_V4} WHEN {_N} >= 8 THEN {_ENDS(4, 4)} ELSE {_BRIEF} END
  WHEN kind IN ('ipv6', 'api_key') AND {_N} >= 8 THEN {_ENDS(4, 4)} ELSE {_SHORT} END, 1, 64)"""


def _summary_sql(column: str) -> str:
    out = f"regexp_replace({column}, '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x{{9f}}]', '', 'g')"
    for pattern, replacement in SUMMARY_RULES:
        safe = pattern.replace("(?<![0-9A-Za-z_])", r"\b").replace("(?![0-9A-Za-z_])", r"\b")
        out = f"regexp_replace({out}, {literal(safe)}, {literal(replacement.replace('$1', chr(92) + '1'))}, 'g')"
    return out


def _documents(s, d):
    return table(s, d, "documents")


def _hits(s, d):
    return pii.with_hits(_documents(s, d))


def _restored(s, d):
    rows = pii.redact(_documents(s, d), SALT)
    back = pii.restore(F.col("redacted"), F.col("placeholders"))
    return rows.withColumn("b", back).select("doc_id", F.size("placeholders").cast("bigint").alias("placeholders"), F.sha2(F.coalesce("b", F.lit("")), 256).alias("restored"))


def _values(s, d):
    hits = _hits(s, d).select("doc_id", F.explode("pii_hits").alias("h"))
    return hits.groupBy("doc_id", F.col("h.kind").alias("kind"), F.col("h.value").alias("value")).agg(F.count("*").alias("hits"))


def _masked(s, d):
    n = F.col("c_custkey")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (n % len(KINDS) + 1).cast("int"))
    value = F.when(n % 5 == 0, F.concat(F.lit("a"), n, F.lit("@ex.org"))).when(n % 5 == 1, F.lpad(n.cast("string"), 16, "4")).when(n % 5 == 2, F.concat(F.lit("8.8."), n % 9, F.lit(".7"))).otherwise(F.substring("c_name", 1, n % 12))
    return table(s, d, "customer").select("c_custkey", kind.alias("kind"), value.alias("value"))


def _partials(s, d):
    n = F.col("event_id")
    left = F.element_at(F.array(*[F.lit(x) for x, _ in PARTIALS]), (n % len(PARTIALS) + 1).cast("int"))
    return table(s, d, "events").select("event_id", text.strip_partial_tokens(F.concat(F.lit("w"), n, F.lit(" "), left)).alias("stripped"))


QUERIES = {
    "mask_llm": lambda s, d: _masked(s, d).select("c_custkey", masks.mask_for_model(F.col("kind"), F.col("value")).alias("mask")),
    "mask_sample": lambda s, d: _masked(s, d).select("c_custkey", masks.mask_for_samples(F.col("kind"), F.col("value")).alias("mask")),
    "summary_redact": lambda s, d: _documents(s, d).select("doc_id", text.redact_summary(F.col("text")).alias("summary")),
    "truncate_marker": lambda s, d: _documents(s, d).select("doc_id", text.truncate_marked(F.col("text"), 100).alias("short")),
    "normalize_model": lambda s, d: _documents(s, d).select("doc_id", text.normalize_model(F.col("text")).alias("model")),
    "strip_partials": _partials,
    "pii_values": _values,
    "pii_hits": lambda s, d: _hits(s, d).select("doc_id", F.explode("pii_hits").alias("h")).select("doc_id", "h.kind", "h.value", "h.start", "h.end"),
    "pii_count_by_kind": lambda s, d: pii.count_by_kind(_hits(s, d)),
    "pii_pages_by_kind": lambda s, d: pii.count_by_kind(pii.with_hits(table(s, d, "pages"), "html")),
    "pii_arbitrated": lambda s, d: _hits(s, d).select("doc_id", F.size(pii.arbitrate(F.col("pii_hits"))).alias("hits")).filter("hits > 0"),
    "pii_sample_maps": lambda s, d: pii.sample_maps(pii.samples(_hits(s, d), by=())),
    "pii_samples_top20": lambda s, d: pii.samples(_hits(s, d)).orderBy(F.desc("hits"), "kind", "hash", "source").limit(20),
    "redact_documents": lambda s, d: pii.redact(_documents(s, d), SALT).select("doc_id", "redacted"),
    "restore_round_trip": _restored,
    "redaction_tally": lambda s, d: pii.redact(_documents(s, d), SALT).groupBy("source").agg(F.sum("n_new").alias("minted"), F.sum("n_seen").alias("seen")),
}
_NUMBER = lambda digits: f"(?:^|[^0-9])({digits})(?:[^0-9]|$)"
#: The patterns without look-around; numbers are searched with every other character doubled.
_PATTERNS_SQL = {
    "email": ("{c}", r"(?:^|[^0-9A-Za-z_.+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"),
    "bank_card": ("regexp_replace({c}, '([^0-9])', '\\1\\1', 'g')", _NUMBER("(?:62|60|34|37)[0-9]{11,17}|[45][0-9]{12,18}")),
    "phone": ("regexp_replace({c}, '([^0-9])', '\\1\\1', 'g')", _NUMBER("1[3-9][0-9]{9}")),
    "ipv4": ("regexp_replace({c}, '([^0-9.])', '\\1\\1', 'g')", r"(?:^|[^0-9.])((?:[0-9]{1,3}\.){3}[0-9]{1,3})(?:[^0-9]|$)"),
    "api_key": ("{c}", r"(?:^|[^0-9A-Za-z-])((?:sk-(?:proj-|ant-)?[A-Za-z0-9_-]{16,}|gh[pous]_[A-Za-z0-9]{16,}|AKIA[0-9A-Z]{16}))"),
}
_D = "CAST(substr(value, length(value) + 1 - i, 1) AS INTEGER)"
_LUHN = f"list_sum(list_transform(range(1, length(value) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {_D} WHEN {_D} * 2 > 9 THEN {_D} * 2 - 9 ELSE {_D} * 2 END)) % 10 = 0"
_O = lambda i: f"TRY_CAST(split_part(value, '.', {i}) AS INTEGER)"
_PUBLIC = f"""(greatest({_O(1)}, {_O(2)}, {_O(3)}, {_O(4)}) <= 255 AND NOT ({_O(1)} IN (10, 127, 0) OR {_O(1)} >= 224 OR ({_O(1)} = 192 AND {_O(2)} = 168) OR ({_O(1)} = 169 AND {_O(2)} = 254)
  OR ({_O(1)} = 198 AND {_O(2)} IN (18, 19)) OR ({_O(1)} = 172 AND ({_O(2)} BETWEEN 16 AND 31 OR CAST({_O(2)} AS VARCHAR) LIKE '2%')) OR ({_O(1)} = 100 AND {_O(2)} BETWEEN 64 AND 127)))"""


def found_sql(name: str, key: str, column: str) -> str:
    """A table expression ``found`` (key, kind, value) of the hits in a column."""
    each = " UNION ALL ".join(
        f"SELECT {key}, '{kind}' AS kind, unnest(regexp_extract_all({given.format(c=f'coalesce({column}, chr(32))')}, {literal(pattern)}, 1)) AS value FROM {name}" for kind, (given, pattern) in _PATTERNS_SQL.items()
    )
    return f"found AS (SELECT * FROM ({each}) WHERE CASE kind WHEN 'bank_card' THEN {_LUHN} WHEN 'ipv4' THEN {_PUBLIC} ELSE true END)"


_FOUND = found_sql("documents", "doc_id", "text")
_TALLY = "tally AS (SELECT doc_id, count(DISTINCT value) AS minted, count(*) AS hits FROM found GROUP BY 1)"
RESTORED_SQL = f"WITH {_FOUND}, {_TALLY} SELECT d.doc_id, coalesce(minted, 0) AS placeholders, sha256(coalesce(text, '')) AS restored FROM documents d LEFT JOIN tally t ON d.doc_id = t.doc_id"
_MASKED_SQL = f"""(SELECT c_custkey, list_extract([{', '.join(map(literal, KINDS))}], CAST(c_custkey % {len(KINDS)} + 1 AS BIGINT)) AS kind, CASE c_custkey % 5 WHEN 0 THEN 'a' || c_custkey || '@ex.org' WHEN 1 THEN lpad(CAST(c_custkey AS VARCHAR), 16, '4')
  WHEN 2 THEN '8.8.' || c_custkey % 9 || '.7' ELSE substr(c_name, 1, c_custkey % 12) END AS value FROM customer)"""
ORACLE_SQL = {
    "mask_llm": f"SELECT c_custkey, {MASK_MODEL_SQL} AS mask FROM {_MASKED_SQL}",
    "mask_sample": f"SELECT c_custkey, {MASK_SAMPLE_SQL} AS mask FROM {_MASKED_SQL}",
    "summary_redact": f"SELECT doc_id, {_summary_sql('text')} AS summary FROM documents",
    "truncate_marker": "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '…[truncated]' ELSE text END AS short FROM documents",
    "normalize_model": """SELECT doc_id, CASE WHEN coalesce(length(m), 0) = 0 THEN 'unknown_model' ELSE m END AS model
      FROM (SELECT doc_id, substr(regexp_replace(text, '[\\x00-\\x1f\\x7f-\\x{9f}]', '', 'g'), 1, 128) AS m FROM documents)""",
    "restore_round_trip": RESTORED_SQL,
    "strip_partials": f"SELECT event_id, 'w' || event_id || ' ' || list_extract([{', '.join(literal(x) for _, x in PARTIALS)}], CAST(event_id % {len(PARTIALS)} + 1 AS BIGINT)) AS stripped FROM events",
    "pii_values": f"WITH {_FOUND} SELECT doc_id, kind, value, count(*) AS hits FROM found GROUP BY 1, 2, 3",
    "pii_count_by_kind": f"WITH {_FOUND} SELECT kind, count(*) AS hits FROM found GROUP BY 1",
    "pii_pages_by_kind": f"WITH {found_sql('pages', 'page_id', 'html')} SELECT kind, count(*) AS hits FROM found GROUP BY 1",
    "pii_arbitrated": f"WITH {_FOUND} SELECT doc_id, CAST(count(*) AS INTEGER) AS hits FROM found GROUP BY 1",
    "pii_sample_maps": f"""WITH {_FOUND}, v AS (SELECT kind, substr(sha256(value), 1, 16) AS hash, count(*) AS hits, max({MASK_SAMPLE_SQL}) AS mask FROM found GROUP BY kind, value),
      m AS (SELECT kind, mask, max((hits, hash)) AS best FROM v GROUP BY kind, mask)
      SELECT kind, '{{' || string_agg(to_json(mask)::VARCHAR || ':{{"count":' || best[1] || ',"hash":"' || best[2] || '"}}', ',' ORDER BY mask) || '}}' AS samples FROM m GROUP BY kind""",
    "pii_samples_top20": f"""WITH {_FOUND} SELECT source, kind, substr(sha256(value), 1, 16) AS hash, count(*) AS hits, max({MASK_SAMPLE_SQL}) AS mask FROM found f JOIN documents d ON f.doc_id = d.doc_id
      GROUP BY 1, 2, 3 ORDER BY hits DESC, kind, hash, source LIMIT 20""",
    "redaction_tally": f"""WITH {_FOUND}, {_TALLY} SELECT source, CAST(sum(coalesce(minted, 0)) AS BIGINT) AS minted, CAST(sum(coalesce(hits - minted, 0)) AS BIGINT) AS seen FROM documents d LEFT JOIN tally t ON d.doc_id = t.doc_id GROUP BY 1""",
    "redact_documents": f"""WITH {_FOUND}, placed AS (SELECT f.doc_id, value, min(instr(text, value)) AS place FROM found f JOIN documents d ON f.doc_id = d.doc_id GROUP BY 1, 2),
      tokens AS (SELECT doc_id, list({{'v': value, 't': '__PII_' || n || '_' || substr({hmac_sql(SALT, "doc_id || chr(31) || value")}, 1, 8) || '__'}} ORDER BY length(value) DESC) AS ts
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS n FROM placed) GROUP BY 1)
      SELECT d.doc_id, CASE WHEN ts IS NULL THEN text ELSE list_reduce(list_prepend({{'v': '', 't': text}}, ts), lambda a, b: {{'v': '', 't': replace(a.t, b.v, b.t)}}).t END AS redacted FROM documents d LEFT JOIN tokens t ON d.doc_id = t.doc_id""",
}
