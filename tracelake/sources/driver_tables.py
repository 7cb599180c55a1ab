"""Projections of the driver tables to the engine's own tables.

``events`` stands in for gateway traffic: kinds of events are mapped to protocols, the value to a
latency and the user to a prompt size.  All derived numbers are integers, so results are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A fixed present for all queries (2024-01-30 00:00 UTC).
NOW = 1_706_572_800
#: Names of the protocols in metrics and in the request log.
METRIC_NAMES = {"chat": "chat/completions", "anthropic": "v1/messages", "responses": "v1/responses"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log, one row per event."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    protocol = F.when(kind.isin("view", "error"), "chat").when(kind == "click", "anthropic").when(kind == "purchase", "responses").otherwise("passthrough")
    base = e.select(
        F.col("event_id").alias("id"),
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("ts_secs"),
        protocol.alias("protocol"),
        F.concat(F.lit("model-"), (F.col("user_id") % 7).cast("string")).alias("model"),
        (F.col("event_id") % 2 == 0).alias("stream"),
        F.when(kind == "error", 500).when(F.col("event_id") % 11 == 0, 404).when(F.col("event_id") % 13 != 0, 200).cast("int").alias("status"),
        F.floor(F.col("value") * 100).cast("long").alias("latency_ms"),
        F.col("user_id").cast("long").alias("prompt_tokens"),
        F.coalesce(k, F.lit(0)).alias("completion_tokens"),
        F.least(F.col("user_id"), F.col("event_id") % 10).cast("long").alias("cached_read"),
        (F.col("event_id") % 5).cast("long").alias("cached_write"),
        F.when(F.col("event_id") % 3 != 0, F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 16)).alias("session_id"),
        F.when(F.col("event_id") % 17 == 0, "silent_discard").when(F.col("event_id") % 19 == 0, "open_ended").when(F.col("event_id") % 23 == 0, "upstream_error").alias("truncated_mode"),
    )
    return base.select(
        "*",
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        (F.col("protocol") != "passthrough").alias("is_chat"),
        F.when(F.col("stream"), F.floor(F.col("latency_ms") / 4).cast("int")).alias("ttft_ms"),
        F.when(F.col("session_id").isNull(), "none").when(F.col("id") % 2 == 0, "session").otherwise("user").alias("session_scope"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric samples: dialog requests only, protocols under their metric names."""
    name = F.lit(None).cast("string")
    for short, long in METRIC_NAMES.items():
        name = F.when(F.col("protocol") == short, long).otherwise(name)
    return requests(spark, sf_dir).filter("is_chat").withColumn("protocol", name).withColumn("is_precise", F.lit(True))


#: The same projection for DuckDB, as common table expressions.
REQUESTS_SQL = """
base AS (
  SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS ts_secs,
    CASE WHEN event_type IN ('view','error') THEN 'chat' WHEN event_type='click' THEN 'anthropic' WHEN event_type='purchase' THEN 'responses' ELSE 'passthrough' END AS protocol,
    'model-' || CAST(user_id % 7 AS VARCHAR) AS model, event_id % 2 = 0 AS stream,
    CAST(CASE WHEN event_type='error' THEN 500 WHEN event_id % 11 = 0 THEN 404 WHEN event_id % 13 <> 0 THEN 200 END AS INTEGER) AS status,
    CAST(floor(value * 100) AS BIGINT) AS latency_ms, CAST(user_id AS BIGINT) AS prompt_tokens,
    coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS completion_tokens,
    CAST(least(user_id, event_id % 10) AS BIGINT) AS cached_read, CAST(event_id % 5 AS BIGINT) AS cached_write,
    CASE WHEN event_id % 3 <> 0 THEN substr(sha256(CAST(user_id AS VARCHAR)), 1, 16) END AS session_id,
    CASE WHEN event_id % 17 = 0 THEN 'silent_discard' WHEN event_id % 19 = 0 THEN 'open_ended' WHEN event_id % 23 = 0 THEN 'upstream_error' END AS truncated_mode
  FROM events),
requests AS (
  SELECT *, prompt_tokens + completion_tokens AS total_tokens, protocol <> 'passthrough' AS is_chat,
    CASE WHEN stream THEN CAST(latency_ms // 4 AS INTEGER) END AS ttft_ms,
    CASE WHEN session_id IS NULL THEN 'none' WHEN id % 2 = 0 THEN 'session' ELSE 'user' END AS session_scope
  FROM base),
samples AS (
  SELECT * REPLACE (CASE protocol WHEN 'chat' THEN 'chat/completions' WHEN 'anthropic' THEN 'v1/messages' ELSE 'v1/responses' END AS protocol)
  FROM requests WHERE is_chat)"""
