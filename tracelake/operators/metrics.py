"""Traffic metrics: window rollups, snapshots, series, request pages and retention."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.histogram import BOUNDS_VERSION, bucket_counts, merged_counts, p95, p95_saturated
from ..functions.timewin import KEEP, RANGES, SPANS, floor_div, parse_range, window_ord
from .folds import fold_sorted

COUNTERS = ("prompt_tokens", "completion_tokens", "total_tokens", "cached_read", "cached_write")
#: Modes of truncated streams and their counters.
TRUNCATION = {"silent_discard": "t_silent", "open_ended": "t_open", "synthesized_failed": "t_synth", "upstream_error": "t_upstream_error"}
RING = 10_000
SERIES_LIMIT = 500
PAGE_LIMIT, PAGE_DEFAULT, OFFSET_LIMIT = 200, 50, 10_000


def _sums(*names: str) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


def _fan_out(rows: DataFrame, granularities: tuple[str, ...] = tuple(SPANS)) -> DataFrame:
    """Every row once for each granularity, with its window."""
    windows = F.array(*[F.struct(F.lit(g).alias("granularity"), window_ord(F.col("ts_secs"), g).alias("window_ord")) for g in granularities])
    return rows.withColumn("_w", F.explode(windows)).select("*", "_w.granularity", "_w.window_ord").drop("_w")


def rollup(samples: DataFrame, granularities: tuple[str, ...] = tuple(SPANS)) -> DataFrame:
    """Counters and histogram by granularity, window and protocol.

    One shuffle serves all granularities asked for; partial aggregation leaves at most one row per
    key and task.
    """
    modes = [F.count_if(F.col("truncated_mode") == mode).alias(name) for mode, name in TRUNCATION.items()]
    return (
        _fan_out(samples, granularities).groupBy("granularity", "window_ord", "protocol")
        .agg(F.count("*").alias("requests"), *_sums(*COUNTERS), *modes, bucket_counts(F.col("latency_ms")).alias("buckets"))
        .withColumn("bucket_bounds_version", F.lit(BOUNDS_VERSION))
    )


def merge_rollups(old: DataFrame, new: DataFrame, add: bool) -> DataFrame:
    """Upsert by key: ``add`` sums old and new rows, otherwise a new row takes the old one's place."""
    keys = ["granularity", "window_ord", "protocol"]
    if not add:
        return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))
    return merged_rollups(old.unionByName(new))


def merged_rollups(partials: DataFrame) -> DataFrame:
    """Any number of rows of a key summed up as one."""
    numbers = ["requests", *COUNTERS, *TRUNCATION.values()]
    return (
        partials.groupBy("granularity", "window_ord", "protocol")
        .agg(*_sums(*numbers), merged_counts(F.col("buckets"), F.col("bucket_bounds_version")).alias("buckets"))
        .withColumn("bucket_bounds_version", F.lit(BOUNDS_VERSION))
    )


def series(rollups: DataFrame, granularity: str, since_ord: int | None = None, protocol: str | None = None) -> DataFrame:
    """Points of one granularity in order; of more than 500 the oldest are returned."""
    rows = rollups.filter(F.col("granularity") == (granularity if granularity in SPANS else "h"))
    if since_ord is not None:
        rows = rows.filter(F.col("window_ord") >= since_ord)
    if protocol:
        rows = rows.filter(F.col("protocol") == protocol)
    span = SPANS.get(granularity, SPANS["h"])
    return (
        rows.orderBy("window_ord", "protocol").limit(SERIES_LIMIT)
        .withColumn("ts_start", F.col("window_ord") * span).withColumn("p95_ms", p95(F.col("buckets"))).withColumn("p95_saturated", p95_saturated(F.col("buckets")))
    )


def newest_windows(rollups: DataFrame, keep: dict[str, int] = KEEP) -> DataFrame:
    """Retention: the newest windows of a granularity across protocols; of five minutes, by protocol.

    The windows of a granularity are first reduced to distinct ordinals, a few rows per key, before
    they are ranked.
    """
    out = None
    for g, n in keep.items():
        by = ["granularity"] if g != "m" else ["granularity", "protocol"]
        rows = rollups.filter(F.col("granularity") == g)
        ranked = rows.select(*by, "window_ord").distinct().withColumn("_r", F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc("window_ord"))))
        kept = rows.join(ranked.filter(F.col("_r") <= n).drop("_r"), [*by, "window_ord"], "left_semi")
        out = kept if out is None else out.unionByName(kept)
    return out


def newest_per_protocol(rollups: DataFrame, keep: dict[str, int] = KEEP) -> DataFrame:
    """Retention in memory: the newest windows of each granularity and protocol."""
    rank = F.row_number().over(Window.partitionBy("granularity", "protocol").orderBy(F.desc("window_ord")))
    limit = F.lit(None).cast("int")
    for g, n in keep.items():
        limit = F.when(F.col("granularity") == g, n).otherwise(limit)
    return rollups.withColumn("_r", rank).filter(F.col("_r") <= limit).drop("_r")


def ring(samples: DataFrame, size: int = RING) -> DataFrame:
    """The newest samples; a top-k, which keeps at most ``size`` rows per task."""
    return samples.orderBy(F.desc("ts_secs"), F.desc("id")).limit(size)


def global_snapshot(samples: DataFrame, size: int = RING) -> DataFrame:
    """One row over the ring: totals, truncations, percentile and precision."""
    last = ring(samples, size)
    modes = [F.count_if(F.col("truncated_mode") == mode).alias(name) for mode, name in TRUNCATION.items()]
    row = last.agg(
        F.count("*").alias("requests"), *_sums(*COUNTERS), *modes, bucket_counts(F.col("latency_ms")).alias("buckets"),
        (F.max("ts_secs") - F.min("ts_secs")).alias("coverage_secs"),
    )
    return row.select(
        "*", p95(F.col("buckets")).alias("p95_ms"), p95_saturated(F.col("buckets")).alias("p95_saturated"),
        ((F.col("coverage_secs") >= 3600) & (F.col("requests") >= 100)).alias("is_precise"),
    ).drop("buckets")


def counts_by(samples: DataFrame, column: str) -> DataFrame:
    """Requests by protocol or model, most first."""
    return samples.groupBy(column).agg(F.count("*").alias("requests")).orderBy(F.desc("requests"), column)


def range_snapshot(samples: DataFrame, range_name: str, now: int) -> DataFrame:
    """One row for a named range: second-exact where the ring covers it, else by whole windows."""
    name, span, granularity = parse_range(range_name)
    since = now - span
    if name == "1h":
        last = ring(samples)
        rows, since_ts = last.filter(F.col("ts_secs") >= since), since
        earliest = last.agg(F.min("ts_secs").alias("earliest"))
    else:
        since_ts = since // SPANS[granularity] * SPANS[granularity]
        rows = samples.filter(F.col("ts_secs") >= since_ts)
        earliest = samples.agg((floor_div(F.min("ts_secs"), SPANS[granularity]) * SPANS[granularity]).alias("earliest"))
    total = rows.agg(F.count("*").alias("requests"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS], bucket_counts(F.col("latency_ms")).alias("buckets"))
    one = F.lit(1).alias("_one")
    joined = total.select("*", one).join(F.broadcast(earliest.select("earliest", one)), "_one").drop("_one")  # one row each
    coverage = F.coalesce(F.greatest(F.lit(now) - F.greatest(F.lit(since), F.col("earliest")), F.lit(0)), F.lit(0)).cast("long")
    full = F.col("coverage_secs") >= span
    return joined.select(
        F.lit(name).alias("range"), F.lit(since_ts).cast("long").alias("since_ts"), coverage.alias("coverage_secs"),
        "requests", *COUNTERS, p95(F.col("buckets")).alias("p95_ms"), p95_saturated(F.col("buckets")).alias("p95_saturated"),
    ).select("*", (~full).alias("partial"), (full & (F.col("requests") >= 100)).alias("is_precise"))


# --- request log ------------------------------------------------------------------------------
@dataclass(frozen=True)
class RequestFilter:
    """Conditions of a request page; those that are None do not count."""

    start_ts: int | None = None
    model: str | None = None
    protocol: str | None = None
    status: str | None = None
    session_prefix: str | None = None
    session_scope: str | None = None
    dialog_only: bool = False
    limit: int = PAGE_DEFAULT
    offset: int = 0

    def __post_init__(self) -> None:
        if self.offset > OFFSET_LIMIT or self.offset < 0:
            raise ValueError(f"offset {self.offset}")
        if self.status not in (None, "2xx", "4xx", "5xx", "error"):
            raise ValueError(f"status {self.status!r}")
        if self.session_prefix is not None and len(self.session_prefix) < 4:
            raise ValueError("a session prefix has four characters at least")
        if self.session_scope not in (None, "any", "session", "user"):
            raise ValueError(f"scope {self.session_scope!r}")

    def condition(self) -> Column:
        terms = [F.lit(True)]
        if self.start_ts is not None:
            terms.append(F.col("ts_secs") >= self.start_ts)
        if self.model:
            terms.append(F.col("model") == self.model)
        if self.protocol:
            terms.append(F.col("protocol") == self.protocol)
        if self.status == "error":
            terms.append(F.col("status").isNull() | (F.col("status") >= 400))
        elif self.status:
            terms.append(F.col("status").between(100 * int(self.status[0]), 100 * int(self.status[0]) + 99))
        if self.session_prefix:
            terms.append(F.col("session_id").startswith(self.session_prefix.lower()))
        if self.session_scope in ("session", "user"):
            terms.append(F.col("session_scope") == self.session_scope)
        if self.dialog_only:
            terms.append(F.col("is_chat"))
        out = terms[0]
        for t in terms[1:]:
            out = out & t
        return out


def ratio(part: Column, whole: Column) -> Column:
    """Null where the whole is zero."""
    return F.when(whole != 0, part / whole)


def cache_input(protocol: Column, prompt: Column, read: Column, write: Column) -> Column:
    """Tokens that a cache could have served; one protocol counts them beside the prompt."""
    return F.when(protocol.isin("anthropic", "v1/messages"), prompt + read + write).otherwise(prompt)


def tokens_per_second(completion: Column, latency_ms: Column, ttft_ms: Column) -> Column:
    return F.when(ttft_ms.isNotNull() & (completion > 0) & (latency_ms > ttft_ms), F.round(completion / ((latency_ms - ttft_ms) / 1000), 1))


def request_page(requests: DataFrame, where: RequestFilter) -> DataFrame:
    """Rows of a page, newest first, with cache ratios and token speed."""
    base = cache_input(F.col("protocol"), F.col("prompt_tokens"), F.col("cached_read"), F.col("cached_write"))
    page = requests.filter(where.condition()).orderBy(F.desc("ts_secs"), F.desc("id")).offset(where.offset).limit(min(max(where.limit, 1), PAGE_LIMIT))
    return page.withColumn("cache_input_tokens", base).select(
        "id", "ts_secs", "protocol", "model", "status", "latency_ms", "total_tokens", "cache_input_tokens",
        ratio(F.col("cached_read"), F.col("cache_input_tokens")).alias("cache_hit_rate"), ratio(F.col("cached_write"), F.col("cache_input_tokens")).alias("cache_write_rate"),
        tokens_per_second(F.col("completion_tokens"), F.col("latency_ms"), F.col("ttft_ms")).alias("tps"),
    )


def request_totals(requests: DataFrame, where: RequestFilter) -> DataFrame:
    """Count, cache sums, hit rate (a ratio of sums) and the earliest row of all matching rows."""
    base = cache_input(F.col("protocol"), F.col("prompt_tokens"), F.col("cached_read"), F.col("cached_write"))
    sums = requests.filter(where.condition()).agg(
        F.count("*").alias("total"), F.sum("cached_read").alias("cached_read"), F.sum(base).alias("cache_input_tokens"), F.min("ts_secs").alias("earliest_ts")
    )
    return sums.withColumn("hit_rate", ratio(F.col("cached_read"), F.col("cache_input_tokens")))


def retention_earliest(requests: DataFrame, start_ts: int) -> DataFrame:
    """The earliest row of a range, whatever the other conditions."""
    return requests.filter(F.col("ts_secs") >= start_ts).agg(F.min("ts_secs").alias("earliest_ts"))


def model_rollup(requests: DataFrame) -> DataFrame:
    """Requests and tokens by granularity, window, protocol and model."""
    base = cache_input(F.col("protocol"), F.col("prompt_tokens"), F.col("cached_read"), F.col("cached_write"))
    rows = requests.filter("is_chat").withColumn("cache_input_tokens", base)
    return _fan_out(rows).groupBy("granularity", "window_ord", "protocol", "model").agg(F.count("*").alias("requests"), *_sums(*COUNTERS, "cache_input_tokens"))


def top_models(rollups: DataFrame, start_ts: int, granularity: str) -> DataFrame:
    """Requests by model from a time on, most first."""
    rows = rollups.filter((F.col("granularity") == granularity) & (F.col("window_ord") >= start_ts // SPANS[granularity]))
    return rows.groupBy("model").agg(F.sum("requests").alias("requests")).orderBy(F.desc("requests"), "model")


def status_classes(requests: DataFrame) -> DataFrame:
    label = F.when(F.col("status").isNull(), "none").otherwise(F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx")))
    return requests.groupBy(label.alias("status_class")).agg(F.count("*").alias("requests"), F.count_if(F.col("status").isNull() | (F.col("status") >= 400)).alias("errors"))


# --- rate limits ------------------------------------------------------------------------------
def min_gap_admit(hits: DataFrame, key: str, ts: str, gap: int) -> DataFrame:
    """Admit a hit if none was admitted within ``gap`` seconds before; rejected ones do not count.

    History matters only through the last admitted hit, so a key's hits are folded in order of time
    with that and two counters.  A hit without a time counts as a hit and is never admitted; hits
    without a key are one key.
    """

    def step(state: list, row: dict) -> None:
        state[1] += 1
        now = row[ts]
        if now is not None and (state[0] is None or now - state[0] >= gap):
            state[0] = now
            state[2] += 1

    columns = hits.select(key, F.col(ts).cast("long").alias(ts))
    schema = f"`{key}` {columns.schema[key].dataType.simpleString()}, hits long, admitted long"
    return fold_sorted(columns, key, (ts,), schema, lambda: [None, 0, 0], step, lambda k, state: (k, state[1], state[2]))
