"""Latency histogram of twelve buckets and the percentile read from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds in milliseconds, the last bucket has none; the version of these bounds.
BOUNDS = (50, 100, 200, 400, 800, 1500, 3000, 5000, 10000, 20000, 40000)
BOUNDS_VERSION = 2


def bucket_index(latency_ms: Column) -> Column:
    """The first bucket whose bound is not below the latency."""
    steps = reduce(lambda w, ib: w.when(latency_ms <= ib[1], ib[0]), list(enumerate(BOUNDS))[1:], F.when(latency_ms <= BOUNDS[0], 0))
    return steps.otherwise(len(BOUNDS))


def bucket_counts(latency_ms: Column) -> Column:
    """Aggregate: the twelve counts as an array."""
    index = bucket_index(latency_ms)
    return F.array(*[F.count_if(index == i) for i in range(len(BOUNDS) + 1)])


def merged_counts(buckets: Column, version: Column) -> Column:
    """Aggregate: the sum of arrays of counts; rows with other bounds add nothing."""
    return F.array(*[F.coalesce(F.sum(F.when(version == BOUNDS_VERSION, F.get(buckets, i))), F.lit(0)) for i in range(len(BOUNDS) + 1)])


def _rank_bucket(buckets: Column) -> tuple[Column, Column, Column]:
    """(rank of the percentile, bucket that holds it, count before that bucket)."""
    total = F.aggregate(buckets, F.lit(0).cast("long"), lambda a, x: a + x)
    rank = F.ceil(total * F.lit(0.95)).cast("long")
    running = [F.aggregate(F.slice(buckets, 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x) for i in range(len(BOUNDS) + 1)]
    bucket = reduce(lambda w, i: w.when(running[i] >= rank, i), range(1, len(running)), F.when(running[0] >= rank, 0))
    before = reduce(lambda w, i: w.when(running[i] >= rank, running[i - 1]), range(1, len(running)), F.when(running[0] >= rank, F.lit(0).cast("long")))
    return F.when(total > 0, rank), bucket, before


def p95(buckets: Column) -> Column:
    """Midpoint interpolation inside the bucket of the 95th percentile, in whole milliseconds.

    An empty histogram gives 0; the bucket without a bound gives the last bound.
    """
    rank, bucket, before = _rank_bucket(buckets)
    lower = F.get(F.array(*[F.lit(b) for b in (0, *BOUNDS)]), bucket)
    upper = F.get(F.array(*[F.lit(b) for b in (*BOUNDS, BOUNDS[-1])]), bucket)
    inside = F.floor((upper - lower) * (2 * (rank - before) - 1) / (2 * F.get(buckets, bucket)))
    return F.when(rank.isNull(), 0).when(bucket == len(BOUNDS), BOUNDS[-1]).otherwise(F.least(upper, lower + inside)).cast("long")


def p95_saturated(buckets: Column) -> Column:
    rank, bucket, _ = _rank_bucket(buckets)
    return F.coalesce(rank.isNotNull() & (bucket == len(BOUNDS)), F.lit(False))
