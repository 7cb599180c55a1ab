"""Queries over the traffic metrics, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.histogram import BOUNDS, BOUNDS_VERSION
from ..functions.timewin import KEEP, SPANS
from ..operators import metrics as m
from ..sources.driver_tables import NOW, REQUESTS_SQL, requests, samples

WITH = "WITH " + REQUESTS_SQL
_COUNTERS_SQL = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in m.COUNTERS)
_MODES_SQL = ", ".join(f"CAST(count(*) FILTER (WHERE truncated_mode = '{mode}') AS BIGINT) AS {name}" for mode, name in m.TRUNCATION.items())
_BUCKET_SQL = "CASE " + " ".join(f"WHEN latency_ms <= {b} THEN {i}" for i, b in enumerate(BOUNDS)) + f" ELSE {len(BOUNDS)} END"
_LOWER = "[" + ", ".join(map(str, (0, *BOUNDS))) + "]"
_UPPER = "[" + ", ".join(map(str, (*BOUNDS, BOUNDS[-1]))) + "]"


def _p95_sql(keys: str, source: str) -> str:
    """p95_ms and p95_saturated by ``keys`` of ``source``, from the twelve buckets."""
    on = f"PARTITION BY {keys} " if keys else ""
    group = f"{keys}, b" if keys else "b"
    lead = f"{keys}, " if keys else ""
    return f"""
      SELECT {lead}CAST(CASE WHEN b = {len(BOUNDS)} THEN {BOUNDS[-1]} ELSE least({_UPPER}[b + 1],
          {_LOWER}[b + 1] + ({_UPPER}[b + 1] - {_LOWER}[b + 1]) * (2 * (rank - (acc - c)) - 1) // (2 * c)) END AS BIGINT) AS p95_ms,
        b = {len(BOUNDS)} AS p95_saturated
      FROM (SELECT *, CAST(ceil(sum(c) OVER ({on}) * 0.95::DOUBLE) AS BIGINT) AS rank, CAST(sum(c) OVER ({on}ORDER BY b) AS BIGINT) AS acc
            FROM (SELECT {lead}{_BUCKET_SQL} AS b, count(*) AS c FROM {source} GROUP BY {group}))
      WHERE acc >= rank AND acc - c < rank"""


def _fan_sql(source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{g}' AS granularity, CAST(floor(ts_secs / {n}.0) AS BIGINT) AS window_ord, * FROM {source}" for g, n in SPANS.items())


def _rollups(spark, d):
    return m.rollup(samples(spark, d))


def _series(g):
    return lambda spark, d: m.series(m.rollup(samples(spark, d), (g,)), g).drop("buckets", "bucket_bounds_version")


def _series_sql(g: str) -> str:
    return f"""{WITH}, w AS (SELECT *, CAST(floor(ts_secs / {SPANS[g]}.0) AS BIGINT) AS window_ord FROM samples),
      p AS ({_p95_sql("window_ord, protocol", "w")})
      SELECT '{g}' AS granularity, a.*, a.window_ord * {SPANS[g]} AS ts_start, p.p95_ms, p.p95_saturated
      FROM (SELECT window_ord, protocol, count(*) AS requests, {_COUNTERS_SQL}, {_MODES_SQL} FROM w GROUP BY window_ord, protocol) a
      JOIN p USING (window_ord, protocol) ORDER BY window_ord, protocol LIMIT {m.SERIES_LIMIT}"""


def _retention_sql(by_protocol: tuple[str, ...]) -> str:
    parts = []
    for g, n in KEEP.items():
        part = "PARTITION BY protocol " if g in by_protocol else ""
        parts.append(f"SELECT granularity, window_ord, protocol, requests FROM (SELECT *, dense_rank() OVER ({part}ORDER BY window_ord DESC) AS r FROM k WHERE granularity = '{g}') WHERE r <= {n}")
    return f"{WITH}, k AS (SELECT granularity, window_ord, protocol, count(*) AS requests FROM ({_fan_sql('samples')}) GROUP BY ALL) " + " UNION ALL ".join(parts)


def _range_sql(name: str, span: int, g: str) -> str:
    since = NOW - span
    if name == "1h":
        source, aligned, floor = f"(SELECT * FROM samples ORDER BY ts_secs DESC, id DESC LIMIT {m.RING})", since, "min(ts_secs)"
    else:
        source, aligned, floor = "samples", since // SPANS[g] * SPANS[g], f"CAST(floor(min(ts_secs) / {SPANS[g]}.0) AS BIGINT) * {SPANS[g]}"
    coalesced = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in m.COUNTERS)
    return f"""{WITH}, src AS (SELECT * FROM {source}), rows AS (SELECT * FROM src WHERE ts_secs >= {aligned}),
      e AS (SELECT CAST(coalesce(greatest({NOW} - greatest({since}, {floor}), 0), 0) AS BIGINT) AS coverage_secs FROM src),
      p AS ({_p95_sql("", "rows")})
      SELECT '{name}' AS range, CAST({aligned} AS BIGINT) AS since_ts, e.coverage_secs, a.*,
        coalesce((SELECT p95_ms FROM p), 0) AS p95_ms, coalesce((SELECT p95_saturated FROM p), false) AS p95_saturated,
        NOT e.coverage_secs >= {span} AS partial, e.coverage_secs >= {span} AND a.requests >= 100 AS is_precise
      FROM (SELECT count(*) AS requests, {coalesced} FROM rows) a, e"""


_CACHE_SQL = "CASE WHEN protocol = 'anthropic' THEN prompt_tokens + cached_read + cached_write ELSE prompt_tokens END"
PAGE = m.RequestFilter(start_ts=NOW - 14 * 86_400, protocol="chat", status="error", dialog_only=True, limit=100, offset=20)
PAGE_SQL = f"ts_secs >= {NOW - 14 * 86_400} AND protocol = 'chat' AND (status IS NULL OR status >= 400) AND is_chat"
_RATIO = "CASE WHEN {1} <> 0 THEN CAST({0} AS DOUBLE) / {1} END"

def _versions(s, d):
    """Windows of this version of the bounds merged with those of an older one, whose buckets do not count."""
    rows = _rollups(s, d)
    merged = m.merged_rollups(rows.unionByName(rows.withColumn("bucket_bounds_version", F.lit(BOUNDS_VERSION - 1))))
    return merged.select("granularity", "window_ord", "protocol", "requests", F.aggregate("buckets", F.lit(0).cast("long"), lambda a, x: a + x).alias("counted"), F.get("buckets", 0).alias("fastest"))


QUERIES = {
    "series_five_min": _series("m"),
    "series_hourly": _series("h"),
    "series_daily": _series("d"),
    "rollup_windows": lambda s, d: _rollups(s, d).drop("buckets", "bucket_bounds_version"),
    "rollup_overwrite": lambda s, d: m.merge_rollups(_rollups(s, d), m.rollup(samples(s, d).withColumn("protocol", F.lit("chat"))), add=False).select("granularity", "window_ord", "protocol", "requests"),
    "rollup_additive": lambda s, d: m.merge_rollups(m.rollup(samples(s, d).filter("id % 2 = 0")), m.rollup(samples(s, d).filter("id % 2 = 1")), add=True).drop("buckets", "bucket_bounds_version"),
    "rollup_versions": _versions,
    "retention_global": lambda s, d: m.newest_windows(_rollups(s, d)).select("granularity", "window_ord", "protocol", "requests"),
    "retention_per_protocol": lambda s, d: m.newest_per_protocol(_rollups(s, d)).select("granularity", "window_ord", "protocol", "requests"),
    "global_snapshot_last_10000": lambda s, d: m.global_snapshot(samples(s, d)),
    "requests_by_protocol": lambda s, d: m.counts_by(samples(s, d), "protocol"),
    "requests_by_model": lambda s, d: m.counts_by(samples(s, d), "model"),
    "range_snapshot_1h": lambda s, d: m.range_snapshot(samples(s, d), "1h", NOW),
    "metrics_snapshot_24h": lambda s, d: m.range_snapshot(samples(s, d), "24h", NOW),
    "range_snapshot_7d": lambda s, d: m.range_snapshot(samples(s, d), "7d", NOW),
    "range_snapshot_30d": lambda s, d: m.range_snapshot(samples(s, d), "30d", NOW),
    "requests_page": lambda s, d: m.request_page(requests(s, d), PAGE),
    "requests_totals": lambda s, d: m.request_totals(requests(s, d), PAGE),
    "requests_session_prefix": lambda s, d: m.request_totals(requests(s, d), m.RequestFilter(session_prefix="6b86", session_scope="session")),
    "retention_earliest": lambda s, d: m.retention_earliest(requests(s, d), NOW - 7 * 86_400),
    "status_class_counts": lambda s, d: m.status_classes(requests(s, d)),
    "tokens_per_sec": lambda s, d: requests(s, d).select("id", m.tokens_per_second(F.col("completion_tokens"), F.col("latency_ms"), F.col("ttft_ms")).alias("tps")),
    "cache_ratio": lambda s, d: requests(s, d).groupBy("protocol").agg(
        m.ratio(F.sum("cached_read"), F.sum(m.cache_input(F.col("protocol"), F.col("prompt_tokens"), F.col("cached_read"), F.col("cached_write")))).alias("hit_rate")
    ),
    "model_rollup": lambda s, d: m.model_rollup(requests(s, d)),
    "top_models": lambda s, d: m.top_models(m.model_rollup(requests(s, d)), NOW - 7 * 86_400, "d"),
    "rate_limit_min_gap": lambda s, d: m.min_gap_admit(requests(s, d), "prompt_tokens", "ts_secs", 3_600),
}
_GROUP = f"count(*) AS requests, {_COUNTERS_SQL}, {_MODES_SQL}"
ORACLE_SQL = {
    "series_five_min": _series_sql("m"),
    "series_hourly": _series_sql("h"),
    "series_daily": _series_sql("d"),
    "rollup_windows": f"{WITH} SELECT granularity, window_ord, protocol, {_GROUP} FROM ({_fan_sql('samples')}) GROUP BY granularity, window_ord, protocol",
    "rollup_additive": f"{WITH} SELECT granularity, window_ord, protocol, {_GROUP} FROM ({_fan_sql('samples')}) GROUP BY granularity, window_ord, protocol",
    "rollup_overwrite": f"""{WITH}, k AS (SELECT granularity, window_ord, protocol, count(*) AS n FROM ({_fan_sql('samples')}) GROUP BY ALL)
      SELECT granularity, window_ord, 'chat' AS protocol, CAST(sum(n) AS BIGINT) AS requests FROM k GROUP BY 1, 2 UNION ALL SELECT granularity, window_ord, protocol, n FROM k WHERE protocol <> 'chat'""",
    "rollup_versions": f"""{WITH} SELECT granularity, window_ord, protocol, 2 * count(*) AS requests, count(*) AS counted, count(*) FILTER (WHERE latency_ms <= {BOUNDS[0]}) AS fastest
      FROM ({_fan_sql('samples')}) GROUP BY granularity, window_ord, protocol""",
    "retention_global": _retention_sql(("m",)),
    "retention_per_protocol": _retention_sql(("d", "h", "m")),
    "global_snapshot_last_10000": f"""{WITH}, last AS (SELECT * FROM samples ORDER BY ts_secs DESC, id DESC LIMIT {m.RING}), p AS ({_p95_sql("", "last")})
      SELECT a.*, p.*, coverage_secs >= 3600 AND requests >= 100 AS is_precise
      FROM (SELECT {_GROUP}, max(ts_secs) - min(ts_secs) AS coverage_secs FROM last) a, p""",
    "requests_by_protocol": f"{WITH} SELECT protocol, count(*) AS requests FROM samples GROUP BY protocol",
    "requests_by_model": f"{WITH} SELECT model, count(*) AS requests FROM samples GROUP BY model",
    "range_snapshot_1h": _range_sql("1h", 3_600, "m"),
    "metrics_snapshot_24h": _range_sql("24h", 86_400, "h"),
    "range_snapshot_7d": _range_sql("7d", 604_800, "d"),
    "range_snapshot_30d": _range_sql("30d", 2_592_000, "d"),
    "requests_page": f"""{WITH} SELECT id, ts_secs, protocol, model, status, latency_ms, total_tokens, c AS cache_input_tokens,
        {_RATIO.format("cached_read", "c")} AS cache_hit_rate, {_RATIO.format("cached_write", "c")} AS cache_write_rate,
        CASE WHEN ttft_ms IS NOT NULL AND completion_tokens > 0 AND latency_ms > ttft_ms THEN round(completion_tokens / ((latency_ms - ttft_ms) / 1000.0::DOUBLE), 1) END AS tps
      FROM (SELECT *, {_CACHE_SQL} AS c FROM requests WHERE {PAGE_SQL} ORDER BY ts_secs DESC, id DESC LIMIT 100 OFFSET 20)""",
    "requests_totals": f"""{WITH} SELECT *, {_RATIO.format("cached_read", "cache_input_tokens")} AS hit_rate FROM (SELECT count(*) AS total,
        CAST(sum(cached_read) AS BIGINT) AS cached_read, CAST(sum({_CACHE_SQL}) AS BIGINT) AS cache_input_tokens, min(ts_secs) AS earliest_ts FROM requests WHERE {PAGE_SQL})""",
    "requests_session_prefix": f"""{WITH} SELECT *, {_RATIO.format("cached_read", "cache_input_tokens")} AS hit_rate FROM (SELECT count(*) AS total,
        CAST(sum(cached_read) AS BIGINT) AS cached_read, CAST(sum({_CACHE_SQL}) AS BIGINT) AS cache_input_tokens, min(ts_secs) AS earliest_ts
        FROM requests WHERE starts_with(session_id, '6b86') AND session_scope = 'session')""",
    "retention_earliest": f"{WITH} SELECT min(ts_secs) AS earliest_ts FROM requests WHERE ts_secs >= {NOW - 7 * 86_400}",
    "status_class_counts": f"""{WITH} SELECT CASE WHEN status IS NULL THEN 'none' ELSE CAST(status // 100 AS VARCHAR) || 'xx' END AS status_class,
        count(*) AS requests, count(*) FILTER (WHERE status IS NULL OR status >= 400) AS errors FROM requests GROUP BY 1""",
    "tokens_per_sec": f"""{WITH} SELECT id, CASE WHEN ttft_ms IS NOT NULL AND completion_tokens > 0 AND latency_ms > ttft_ms
        THEN round(completion_tokens / ((latency_ms - ttft_ms) / 1000.0::DOUBLE), 1) END AS tps FROM requests""",
    "cache_ratio": f"{WITH} SELECT protocol, {_RATIO.format('sum(cached_read)', f'sum({_CACHE_SQL})')} AS hit_rate FROM requests GROUP BY protocol",
    "model_rollup": f"""{WITH} SELECT granularity, window_ord, protocol, model, count(*) AS requests, {_COUNTERS_SQL}, CAST(sum({_CACHE_SQL}) AS BIGINT) AS cache_input_tokens
      FROM ({_fan_sql("(SELECT * FROM requests WHERE is_chat)")}) GROUP BY granularity, window_ord, protocol, model""",
    "top_models": f"{WITH} SELECT model, count(*) AS requests FROM requests WHERE is_chat AND CAST(floor(ts_secs / 86400.0) AS BIGINT) >= {(NOW - 7 * 86_400) // 86_400} GROUP BY model",
    "rate_limit_min_gap": f"""WITH RECURSIVE {REQUESTS_SQL.strip()}, h AS (SELECT prompt_tokens AS k, ts_secs AS t FROM requests),
      steps AS (SELECT k, min(t) AS t FROM h GROUP BY k UNION ALL
        SELECT s.k, (SELECT min(h.t) FROM h WHERE h.k = s.k AND h.t >= s.t + 3600) FROM steps s WHERE s.t IS NOT NULL)
      SELECT k AS prompt_tokens, (SELECT count(*) FROM h WHERE h.k = steps.k) AS hits, count(t) AS admitted FROM steps GROUP BY k""",
}
KEPT = {"m": 12, "h": 24, "d": 7}
QUERIES["retention_models"] = lambda s, d: (
    m.newest_windows(m.model_rollup(requests(s, d)), KEPT).groupBy("granularity").agg(F.count("*").alias("kept"), F.sum("requests").alias("requests"))
)
ORACLE_SQL["retention_models"] = f"""SELECT granularity, count(*) AS kept, CAST(sum(requests) AS BIGINT) AS requests FROM (SELECT granularity, requests,
    CASE granularity WHEN 'm' THEN dense_rank() OVER (PARTITION BY granularity, protocol ORDER BY window_ord DESC) ELSE dense_rank() OVER (PARTITION BY granularity ORDER BY window_ord DESC) END AS n FROM ({ORACLE_SQL["model_rollup"]}))
  WHERE n <= CASE granularity {" ".join(f"WHEN '{g}' THEN {n}" for g, n in KEPT.items())} END GROUP BY 1"""
