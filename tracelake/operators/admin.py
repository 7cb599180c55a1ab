"""Event ring, command log, auxiliary counters and personal-data samples of the admin pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that the event ring keeps, most rows of a page, and rows replayed to a new listener.
RING_ROWS = 512
PAGE_ROWS = 200
BACKLOG_ROWS = 20
#: Words for the three verdicts.
VERDICTS = {
    "allow": ("allow", "allowed", "pass", "approved"),
    "block": ("block", "blocked", "deny", "rejected"),
    "need_approval": ("need_approval", "needapproval", "pending", "approve", "approval"),
}
AUX = ("pii_hits", "pii_miss", "cred_hits", "audit_blocks")


def normalize_verdict(word: Column) -> Column:
    """allow, block or need_approval; null for any other word."""
    return F.coalesce(*[F.when(F.lower(F.trim(word)).isin(*words), F.lit(verdict)) for verdict, words in VERDICTS.items()])


def newest(events: DataFrame, order: str, n: int) -> DataFrame:
    return events.orderBy(F.desc(order)).limit(n)


def event_page(events: DataFrame, kind: str | None = None, since: int | None = None, verdict: str | None = None, limit: int = 50) -> DataFrame:
    """Newest events of the ring first; the verdict counts only if the ring holds such a kind."""
    ring = newest(events, "id", RING_ROWS)
    if kind is not None:
        ring = ring.filter(F.col("kind") == kind)
    if since is not None:
        ring = ring.filter(F.col("ts_secs") >= since)
    if verdict is not None:
        # The ring is bounded, so one task may look at it whole.
        known = F.max(F.col("kind") == verdict).over(Window.partitionBy(F.lit(1)))
        ring = ring.withColumn("_known", known).filter(~F.col("_known") | (F.col("kind") == verdict)).drop("_known")
    return newest(ring, "id", min(max(limit, 1), PAGE_ROWS))


def backlog(events: DataFrame, wanted: Column) -> DataFrame:
    """The newest events, oldest first; they are taken before ``wanted`` is asked."""
    return newest(events, "id", BACKLOG_ROWS).filter(wanted).orderBy("id")


def since_passes(body: Column, since: int) -> Column:
    """Whether a JSON event is new enough; one without a readable time passes."""
    return F.coalesce(F.get_json_object(body, "$.ts_secs").try_cast("bigint") >= since, F.lit(True))


def command_page(log: DataFrame, equal: dict[str, str], since: int | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the command log, newest first."""
    return command_matches(log, equal, since).orderBy(F.desc("ts_secs"), F.desc("id")).offset(max(offset, 0)).limit(min(max(limit, 1), PAGE_ROWS))


def command_matches(log: DataFrame, equal: dict[str, str], since: int | None = None) -> DataFrame:
    for column, value in equal.items():
        log = log.filter(F.col(column) == value)
    return log if since is None else log.filter(F.col("ts_secs") >= since)


def command_totals(log: DataFrame, equal: dict[str, str], since: int | None = None) -> DataFrame:
    return command_matches(log, equal, since).agg(F.count("*").alias("total"), F.min("ts_secs").alias("earliest"))


def aux_rollup(counts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Sums of the auxiliary counters; saturating: what is negative or unreadable counts as 0."""
    return counts.groupBy(*keys).agg(*[F.sum(saturated(F.col(c))).alias(c) for c in AUX])


def saturated(number: Column) -> Column:
    return F.greatest(F.coalesce(number.try_cast("bigint"), F.lit(0)), F.lit(0))


def merge_samples(samples: DataFrame) -> DataFrame:
    """Personal-data samples by day, upstream, kind and hash: hits, first and last time, latest mask."""
    return samples.groupBy("day", "upstream", "kind", "hash").agg(
        F.count("*").alias("hits"), F.min("ts_secs").alias("first_seen"), F.max("ts_secs").alias("last_seen"), F.max_by("mask", F.struct("ts_secs", "mask")).alias("mask")
    )


def keyed_counts(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row for each counter: how many rows raise its flag."""
    sums = rows.agg(*[F.coalesce(F.sum(F.coalesce(flag, F.lit(False)).cast("bigint")), F.lit(0)).alias(name) for name, flag in flags.items()])
    return sums.unpivot([], list(flags), "key", "count")
