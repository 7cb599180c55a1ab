"""Decisions that depend on all that went before under the same key.

Rows are dealt by key, sorted by key and order in each partition, and folded in one pass with a
state of fixed size, so a key of any number of rows needs no memory of its own.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Seconds that a replaced hash stays valid, and that a ticket waits for a decision.
GRACE = 3_600
TICKET_WAIT = 300
ROWS = 10_000


def fold_sorted(
    rows: DataFrame, key: str, order: tuple[str, ...], schema: str, start: Callable[[], Any], step: Callable[[Any, dict], tuple | list | None], last: Callable[[Any, Any], tuple | list] | None = None
) -> DataFrame:
    """One pass over each key's rows: ``step`` may return a row, or a list of rows, for each, and ``last`` for each key.

    Rows without a key are one key; rows with equal order values may come in any order.
    """
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        current, state, begun = None, None, False

        def batch() -> pa.RecordBatch:
            columns = list(zip(*made)) or [()] * len(types)
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types)], schema=types)
            made.clear()
            return out

        def take(out: tuple | list | None) -> None:
            if out is not None:
                made.extend(out if isinstance(out, list) else [out])

        for b in batches:
            names = b.schema.names
            for low in range(0, b.num_rows, ROWS):
                for values in zip(*(c.to_pylist() for c in b.slice(low, ROWS).columns)):
                    row = dict(zip(names, values))
                    if not begun or row[key] != current:
                        if begun and last:
                            take(last(current, state))
                        current, state, begun = row[key], start(), True
                    take(step(state, row))
                yield batch()
        if begun and last:
            take(last(current, state))
        yield batch()

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def sliding_admit(hits: DataFrame, key: str, ts: str, row_id: str, limit: int = 10, window: int = 60) -> DataFrame:
    """Whether each hit is admitted, and after how many seconds a rejected one may come again.

    A hit is rejected when ``limit`` hits admitted under its key are younger than ``window``
    seconds; rejected hits do not count.
    """

    def step(kept: deque, row: dict) -> tuple:
        now = row[ts]
        while kept and now - kept[0] >= window:
            kept.popleft()
        full = len(kept) >= limit
        retry = max(1, window - (now - kept[0])) if full else 0
        if not full:
            kept.append(now)
        return row[row_id], row[key], not full, retry

    columns = hits.select(F.col(row_id).cast("long"), F.col(key).cast("long"), F.col(ts).cast("long")).filter(F.col(ts).isNotNull())
    return fold_sorted(columns, key, (ts, row_id), "id long, key long, admitted boolean, retry_secs long", deque, step)


REGISTRY = (
    "caller long, expected_hash string, old_hash string, old_hash_expires_at long, enabled boolean, revoked boolean, allow_mode string, authorized_at long, conflicts long, refused long"
)


def registry_state(events: DataFrame) -> DataFrame:
    """State of each caller after its events (caller, seq, op, hash, ts).

    ``register`` makes a new entry, not enabled, unless one is active (a conflict).  ``approve`` and
    ``approve_always`` enable it, ``reject`` and ``revoke`` end it, ``hash_change`` keeps the former
    hash valid for a while; all of these are refused where no entry is active.  Other operations
    are ignored.
    """

    def start() -> dict:
        return {"hash": None, "old": None, "until": None, "enabled": None, "revoked": None, "mode": None, "at": None, "conflicts": 0, "refused": 0}

    def step(s: dict, e: dict) -> None:
        op, active = e["op"], s["revoked"] is False
        if op == "register":
            if active:
                s["conflicts"] += 1
            else:
                s.update(hash=e["hash"], old=None, until=None, enabled=False, revoked=False, mode=None, at=None)
        elif op in ("approve", "approve_always", "reject", "revoke", "hash_change"):
            if not active:
                s["refused"] += 1
            elif op == "hash_change":
                s.update(old=s["hash"], until=e["ts"] + GRACE, hash=e["hash"])
            elif op in ("reject", "revoke"):
                s.update(enabled=False, revoked=True)
            else:
                s.update(enabled=True, at=e["ts"], mode="allow" if op == "approve_always" else s["mode"])

    def last(caller: int, s: dict) -> tuple:
        return caller, s["hash"], s["old"], s["until"], s["enabled"], s["revoked"], s["mode"], s["at"], s["conflicts"], s["refused"]

    return fold_sorted(events.select("caller", "seq", "op", "hash", "ts"), "caller", ("seq",), REGISTRY, start, step, last)


def first_decisions(tickets: DataFrame, reactions: DataFrame, wait: int = TICKET_WAIT) -> DataFrame:
    """The first reaction (key, ts, id, approved) after each ticket (key, ts, id), within ``wait`` seconds.

    Tickets and reactions are sorted together once, latest first, so that the nearest later reaction
    of a ticket is the last one seen; nothing is paired.
    """
    both = tickets.select("key", "ts", "id", F.lit(None).cast("boolean").alias("approved"), F.lit(True).alias("ticket")).unionByName(
        reactions.select("key", "ts", "id", "approved", F.lit(False).alias("ticket"))
    )
    seen = F.struct(F.col("ts").alias("at"), F.col("approved").alias("yes"))
    order = Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("next", F.last(F.when(~F.col("ticket"), seen), ignorenulls=True).over(order)).filter("ticket")
    timely = F.coalesce(F.col("next.at") - F.col("ts") <= wait, F.lit(False))
    state = F.when(~timely, "timeout").when(F.col("next.yes"), "approved").otherwise("denied")
    return near.select("id", "key", state.alias("state"), F.when(timely, F.col("next.at") - F.col("ts")).alias("waited_secs"))


def previous_link(requests: DataFrame, key: str, order: tuple[str, ...], linked: str) -> DataFrame:
    """Each request with the id of the last earlier one under its key for which ``linked`` holds."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    named = requests.filter(F.col(key).isNotNull())
    return named.select("id", key, F.last(F.when(F.expr(linked), F.col("id")), ignorenulls=True).over(before).alias("previous_id"))


def running_cursor(events: DataFrame, key: str, order: tuple[str, ...], value: str) -> DataFrame:
    """Greatest value so far under each key."""
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.select("id", key, F.max(value).over(so_far).alias("cursor"))


def first_notifications(events: DataFrame, *keys: str) -> DataFrame:
    """The first row of each combination of ``keys``, by time and id; map-side, without sorting."""
    return events.groupBy(*keys).agg(F.min(F.struct("ts_secs", "id")).alias("f")).select(*keys, F.col("f.ts_secs").alias("ts_secs"), F.col("f.id").alias("id"))


def counts_with_other(rows: DataFrame, column: str, known: tuple[str, ...]) -> DataFrame:
    """Rows by the known values of ``column``; all others, null too, count as ``other``."""
    name = F.when(F.col(column).isin(*known), F.col(column)).otherwise("other")
    return rows.groupBy(name.alias("name")).agg(F.count("*").alias("n"))


def bind_downstream(calls: DataFrame, downstreams: DataFrame) -> DataFrame:
    """The first downstream by name whose callers hold the path of each call; null if none."""
    bound = downstreams.select("name", F.explode("callers").alias("p")).groupBy("p").agg(F.min("name").alias("downstream"))
    return calls.join(bound, F.col("caller_path") == F.col("p"), "left").select("caller_path", "downstream")
