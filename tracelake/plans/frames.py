"""Queries over frames of answer streams, sessions and JSON bodies, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames, pii
from ..sources.driver_tables import REQUESTS_SQL, requests, table
from ..sources.shared import checkpointed
from .redaction import RESTORED_SQL, SALT



def _redacted(s, d):
    return pii.redact(table(s, d, "documents"), SALT).select(F.col("doc_id").alias("stream"), "text", "redacted", "placeholders")


def _stitched(s, d):
    """Redacted documents cut into frames of 17 characters, restored, and put together again."""
    rows = checkpointed(_redacted(s, d).drop("text"))  # read three times
    cut = rows.select("stream", F.posexplode(F.regexp_extract_all("redacted", F.lit(r"(?s).{1,17}"), F.lit(0))).alias("seq", "delta"))
    whole = frames.restore_frames(cut, rows).groupBy("stream").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("seq", F.lit((1 << 62))).alias("seq"), "text"))).alias("f"))
    text = whole.select(F.col("stream").alias("s"), F.array_join(F.transform("f", lambda x: x["text"]), "").alias("joined"))
    return rows.join(text, F.col("stream") == F.col("s"), "left").select(
        F.col("stream").alias("doc_id"), F.size("placeholders").cast("bigint").alias("placeholders"), F.sha2(F.coalesce("joined", F.lit("")), 256).alias("restored")
    )


def _json_restored(s, d):
    rows = _redacted(s, d).withColumn("body", F.to_json(F.struct(F.array("redacted").alias("content"), F.to_json(F.struct(F.col("redacted").alias("t"))).alias("inner"))))
    body = frames.restore_json(F.col("body"), F.col("placeholders"))
    back = rows.select("stream", "text", "placeholders", body.alias("body"))
    inner = F.get_json_object(F.get_json_object("body", "$.inner"), "$.t")
    return back.select(
        F.col("stream").alias("doc_id"), F.size("placeholders").cast("bigint").alias("placeholders"),
        F.sha2(F.coalesce(F.get_json_object("body", "$.content[0]"), F.lit("")), 256).alias("restored"), F.sha2(F.coalesce(inner, F.lit("")), 256).alias("inner"),
    )


def _held(s, d):
    """Calls of three fragments for each nation; every second one removes files."""
    n = F.col("n_nationkey")
    parts = table(s, d, "nation").select(F.col("n_regionkey").cast("long").alias("stream"), n.cast("long").alias("index"), F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])).alias("seq"))
    i = F.col("index")
    args = F.when(F.col("seq") == 0, "rm ").when(F.col("seq") == 1, F.when(i % 2 == 0, "-rf ").otherwise("-i ")).otherwise(F.concat(F.lit("f"), i))
    return frames.held_calls(parts.select("stream", "index", "seq", F.when(F.col("seq") == 0, "bash").alias("name"), args.alias("args")))


QUERIES = {
    "restore_frames_round_trip": _stitched,
    "restore_json_round_trip": _json_restored,
    "held_calls": _held,
    "idle_sessions": lambda s, d: frames.idle_sessions(requests(s, d).filter("session_id is not null"), "session_id", "ts_secs", 86_400),
    "most_concurrent": lambda s, d: frames.most_concurrent(requests(s, d).withColumn("end_secs", F.col("ts_secs") + F.col("latency_ms") + 1), "model", "ts_secs", "end_secs"),
    "canonical_json": lambda s, d: table(s, d, "events").select("event_id", frames.canonical_json(F.concat(F.lit('{"z": 1, "p": '), F.col("props"), F.lit("}"))).alias("body")),
}
_LOG = f"WITH {REQUESTS_SQL.strip()}"
ORACLE_SQL = {
    "restore_frames_round_trip": RESTORED_SQL,
    "restore_json_round_trip": f"SELECT *, restored AS inner FROM ({RESTORED_SQL})",
    "held_calls": """SELECT CAST(n_regionkey AS BIGINT) AS stream, CAST(n_nationkey AS BIGINT) AS index, 'bash' AS name, 'rm ' || CASE WHEN n_nationkey % 2 = 0 THEN '-rf ' ELSE '-i ' END || 'f' || n_nationkey AS args,
        CASE WHEN n_nationkey % 2 = 0 THEN '危险 shell: rm -rf 递归强制删除' END AS reason, CASE WHEN n_nationkey % 2 = 0 THEN 'block' ELSE 'allow' END AS verdict, CASE WHEN n_nationkey % 2 = 1 THEN CAST(2 AS BIGINT) END AS released_at FROM nation""",
    "idle_sessions": f"""{_LOG}, n AS (SELECT session_id, ts_secs, sum(opens) OVER (PARTITION BY session_id ORDER BY ts_secs RANGE UNBOUNDED PRECEDING) AS session
        FROM (SELECT session_id, ts_secs, CASE WHEN ts_secs - lag(ts_secs) OVER (PARTITION BY session_id ORDER BY ts_secs) <= 86400 THEN 0 ELSE 1 END AS opens FROM requests WHERE session_id IS NOT NULL))
      SELECT session_id, CAST(session AS BIGINT) AS session, min(ts_secs) AS first_ts, max(ts_secs) AS last_ts, count(*) AS requests FROM n GROUP BY 1, 2""",
    "most_concurrent": f"""{_LOG}, c AS (SELECT model, moment, sum(d) AS d FROM (SELECT model, ts_secs AS moment, 1 AS d FROM requests UNION ALL SELECT model, ts_secs + latency_ms + 1, -1 FROM requests) GROUP BY 1, 2)
      SELECT model, CAST(max(n) AS BIGINT) AS most FROM (SELECT model, sum(d) OVER (PARTITION BY model ORDER BY moment) AS n FROM c) GROUP BY 1""",
    "canonical_json": """SELECT event_id, '{"p":{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '},"z":1}' AS body FROM events""",
}
