"""Approvals, registrations and conversations whose state depends on earlier events of others too."""

from __future__ import annotations

import heapq
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import let
from ..functions.wide import as_bits, multiply, rotated, splitmix
from ..sources.shared import checkpointed
from .folds import GRACE, fold_sorted

#: Entries of a decision table, seconds that a decision is kept, and seconds that a
#: response can be continued.
TABLE_ENTRIES, DECISION_TTL, RESPONSE_TTL = 4_096, 60, 1_800
#: First number of the band for indexes that are too large, buckets in it, and bounds of
#: the choices and tool indexes of a chat.
BAND, BAND_SIZE, CHOICES, TOOLS = 0xFF000000, 256, 0xFF00, 1 << 16


def decision_outcomes(events: DataFrame, most: int = TABLE_ENTRIES, ttl: int = DECISION_TTL) -> DataFrame:
    """What each request for a decision meets in its node's table: reserved, busy, approved, denied, timed_out or saturated.

    Events are (node, seq, ts, op, key).  ``begin`` asks; ``approve``, ``deny`` and ``time_out`` decide,
    also unasked; ``consume`` removes.  A decision is kept for ``ttl`` seconds; a full table gives up its
    oldest decision, and refuses where all wait.  ``saturated`` counts refusals so far.  The state of a
    node is bounded by ``most`` and what was decided within ``ttl``.
    """
    decided_as = {"approve": "approved", "deny": "denied", "time_out": "timed_out"}

    def start() -> dict:
        return {"entries": {}, "decided": [], "saturated": 0}

    def evict(s: dict, until: int | None) -> bool:
        """Drop the oldest decision; with ``until`` only one made by then."""
        while s["decided"]:
            ts, key = s["decided"][0]
            if until is not None and ts > until:
                return False
            heapq.heappop(s["decided"])
            if s["entries"].get(key, (None, None))[1] == ts:
                del s["entries"][key]
                return True
        return False

    def step(s: dict, e: dict) -> tuple | None:
        entries, key, op = s["entries"], e["key"], e["op"]
        if op in decided_as:
            entries[key] = (decided_as[op], e["ts"])
            heapq.heappush(s["decided"], (e["ts"], key))
            while len(entries) > most and evict(s, None):
                pass
            return None
        if op == "consume":
            entries.pop(key, None)
            return None
        if op != "begin":
            return None
        while evict(s, e["ts"] - ttl):
            pass
        if key in entries:
            met = entries[key][0]
        elif len(entries) >= most and not evict(s, None):
            s["saturated"] += 1
            met = "saturated"
        else:
            met = "reserved"
            entries[key] = ("busy", None)
        return e["node"], e["seq"], key, met, s["saturated"], len(entries)

    kind = events.schema["node"].dataType.simpleString().replace("bigint", "long")
    return fold_sorted(events.select("node", "seq", "ts", "op", "key"), "node", ("seq",), f"node {kind}, seq long, key string, outcome string, saturated long, entries long", start, step)


def settled_approvals(events: DataFrame) -> DataFrame:
    """How each approval asked for (node, seq, op, id) was settled, and when it was forgotten.

    ``approve`` and ``deny`` settle one; ``lock`` settles all of a node that wait, as denied; ``clear``
    does so and forgets all; ``forget`` forgets the settled ones.  One window over a node's events, latest
    first, gives each row the next bulk event; ids meet their own decision by a join.
    """
    later = Window.partitionBy("node").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("node", "id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    following = lambda ops: F.last(F.when(F.col("op").isin(*ops), F.col("seq")), ignorenulls=True).over(later)
    marked = events.select("node", "seq", "op", "id").withColumns({"lock_at": following(("lock", "clear")), "clear_at": following(("clear",)), "forget_at": following(("forget",))})
    decision = F.last(F.when(F.col("op").isin("approve", "deny"), F.struct("seq", "op", "forget_at", "clear_at")), ignorenulls=True).over(own)
    bulk = marked.filter(F.col("op").isin("lock", "clear")).select(F.col("node").alias("n"), F.col("seq").alias("at"), F.when(F.col("op") == "clear", F.col("seq")).otherwise(F.least("forget_at", "clear_at")).alias("gone"))
    asked = marked.withColumn("d", decision).filter("op = 'ask'")
    mine = F.col("d.seq").isNotNull() & (F.col("lock_at").isNull() | (F.col("d.seq") < F.col("lock_at")))
    told = asked.select(
        "node", "id", "seq", F.when(mine, F.when(F.col("d.op") == "approve", "approved").otherwise("denied")).when(F.col("lock_at").isNotNull(), "locked").otherwise("pending").alias("outcome"),
        F.when(mine, F.col("d.seq")).otherwise(F.col("lock_at")).alias("settled_at"), F.when(mine, F.least("d.forget_at", "d.clear_at")).alias("own_gone"),
    )
    joined = told.join(bulk, (F.col("node") == F.col("n")) & (F.col("settled_at") == F.col("at")), "left")
    return joined.select("node", "id", "seq", "outcome", "settled_at", F.when(F.col("outcome") == "locked", F.col("gone")).otherwise(F.col("own_gone")).alias("gone_at"))


def continued_responses(responses: DataFrame, requests: DataFrame, ttl: int = RESPONSE_TTL) -> DataFrame:
    """The conversation that each request (tenant, id, previous_id, ts) continues.

    It is that of the latest response (tenant, response_id, conversation, ts) with the id before the
    request, no older than ``ttl`` seconds; of several at one moment the greatest.  One sort by id, no pairs.
    """
    said = responses.groupBy("tenant", "response_id", "ts").agg(F.max("conversation").alias("conversation"))
    rows = said.select("tenant", "response_id", "ts", F.lit(1).alias("side"), F.lit(None).cast(requests.schema["id"].dataType).alias("id"), F.struct("ts", "conversation").alias("r")).unionByName(
        requests.select("tenant", F.col("previous_id").alias("response_id"), "ts", F.lit(0).alias("side"), "id", F.lit(None).cast(f"struct<ts:{responses.schema['ts'].dataType.simpleString()},conversation:string>").alias("r"))
    )
    order = Window.partitionBy("tenant", "response_id").orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("r", ignorenulls=True).over(order)
    fresh = (F.col("ts") - F.col("l.ts") <= ttl) & F.col("response_id").isNotNull()
    return rows.withColumn("l", last).filter("side = 0").select("tenant", "id", F.col("response_id").alias("previous_id"), F.when(fresh, F.col("l.conversation")).alias("conversation"))


def connected_names(events: DataFrame) -> DataFrame:
    """(path, group): paths that names tie together, group being the least path of it.

    The least path spreads over names and back, and each round also takes the group of its group, so
    chains close in few rounds; the plan is cut after each.
    """
    edges = checkpointed(events.filter("coalesce(name, '') <> ''").select("path", "name").distinct())
    groups = checkpointed(events.select("path", F.col("path").alias("g")).distinct())
    while True:
        by_name = edges.join(groups, "path").groupBy("name").agg(F.min("g").alias("least"))
        reached = edges.join(by_name, "name").groupBy("path").agg(F.min("least").alias("least"))
        nearer = groups.join(reached, "path", "left").select("path", "g", F.coalesce("least", "g").alias("least"))
        of_group = nearer.groupBy("g").agg(F.min("least").alias("best")).select(F.col("g").alias("old"), "best")
        moved = checkpointed(nearer.join(of_group, F.col("g") == F.col("old")).select("path", F.least("best", "least").alias("g"), (F.least("best", "least") < F.col("g")).alias("changed")))
        groups = moved.select("path", "g")
        if moved.filter("changed").isEmpty():
            return groups.withColumnRenamed("g", "group")


REGISTRY = "path string, name string, expected_hash string, old_hash string, old_hash_expires_at long, enabled boolean, revoked boolean, allow_mode string, authorized_at long, authorized_ttl long, path_conflicts long, name_conflicts long, refused long"


def registry_by_two_keys(events: DataFrame) -> DataFrame:
    """State of each path after its events (seq, op, path, name, hash, mode, ttl, ts) under unique active paths and names.

    ``register`` makes an entry, not enabled and without an authorization, unless its path is active or
    an active entry has its name.  ``revoke`` ends one, ``enable`` and ``disable`` set it (enabling revives
    a revoked one), ``mode`` and ``window`` set theirs, ``hash_change`` keeps the former hash for a while;
    all are refused for a path that was never registered.  A fold for each group of paths that share
    names tells which registrations are made, from narrow rows of the events that begin or end one; its
    state is one entry a path of the group.  All else is folded path by path.
    """
    groups = connected_names(events)
    name = F.trim(F.coalesce("name", F.lit("")))
    told = _made(events.filter(F.col("op").isin("register", "revoke", "enable")).join(groups.withColumnRenamed("path", "p"), F.col("path") == F.col("p")), name)
    absent = lambda c: F.lit(None).cast(events.schema[c].dataType).alias(c)
    rows = events.filter("path is not null").select("path", "seq", F.lit(1).alias("_k"), "op", name.alias("name"), "hash", "mode", "ttl", "ts", F.lit(None).cast("int").alias("met")).unionByName(
        told.select("path", "seq", F.lit(0).alias("_k"), absent("op"), absent("name"), absent("hash"), absent("mode"), absent("ttl"), absent("ts"), "met")
    )

    def start() -> dict:
        return {"entry": None, "counts": [0, 0, 0], "met": deque()}

    def step(s: dict, e: dict) -> None:
        entry, op = s["entry"], e["op"]
        if e["_k"] == 0:
            s["met"].append(e["met"])
        elif op == "register":
            met = s["met"].popleft()
            if met != MADE:
                s["counts"][met] += 1
            else:
                s["entry"] = {"name": e["name"], "hash": e["hash"], "old": None, "until": None, "enabled": False, "revoked": False, "mode": e["mode"], "at": None, "ttl": e["ttl"]}
        elif entry is None:
            s["counts"][2] += 1
        elif op == "revoke":
            entry.update(revoked=True, enabled=False)
        elif op in ("enable", "disable"):
            entry["enabled"] = op == "enable"
            entry["revoked"] = entry["revoked"] and op != "enable"
        elif op == "mode":
            entry["mode"] = e["mode"]
        elif op == "window":
            entry.update(at=e["ts"], ttl=e["ttl"])
        elif op == "hash_change":
            if e["hash"] != entry["hash"]:
                entry.update(old=entry["hash"], until=e["ts"] + GRACE, hash=e["hash"])

    def last(path: str, s: dict) -> tuple:
        none = dict.fromkeys(("name", "hash", "old", "until", "enabled", "revoked", "mode", "at", "ttl"))
        return path, *((s["entry"] or none)[k] for k in none), *s["counts"]

    return fold_sorted(rows, "path", ("seq", "_k"), REGISTRY, start, step, last)


#: What a registration meets: an active entry of its path, one of its name, or neither.
PATH_TAKEN, NAME_TAKEN, MADE = 0, 1, 2


def _made(events: DataFrame, name: Column) -> DataFrame:
    """(path, seq, met) of each registration, by a fold over the events (group, seq, op, path) of its group."""
    op = F.when(F.col("op") == "register", 0).when(F.col("op") == "revoke", 1).otherwise(2).cast("tinyint")
    rows = events.select("group", "seq", "path", op.alias("op"), F.when(op == 0, name).alias("name"))

    def start() -> dict:
        return {"entries": {}, "active": {}}  # path to [name, active]; name to how many are

    def step(s: dict, e: dict) -> tuple | None:
        path, op, active = e["path"], e["op"], s["active"]
        entry = s["entries"].get(path)
        if op == 0:
            if entry and entry[1]:
                return path, e["seq"], PATH_TAKEN
            if e["name"] and active.get(e["name"]):
                return path, e["seq"], NAME_TAKEN
            s["entries"][path] = [e["name"], True]
            active[e["name"]] = active.get(e["name"], 0) + 1
            return path, e["seq"], MADE
        if entry and entry[1] != (op == 2):
            entry[1] = op == 2
            active[entry[0]] += 1 if entry[1] else -1
        return None

    return fold_sorted(rows, "group", ("seq",), "path string, seq long, met int", start, step)


def tool_bucket(index: Column) -> Column:
    """A tool index (from 0 to 2**64 - 1) as a bucket; one that is too large goes to a band by its hash."""
    plain = (index >= 0) & (index < BAND)
    return F.when(plain, index.cast("long")).otherwise(F.lit(BAND).cast("long") + splitmix(as_bits(index)).bitwiseAND(BAND_SIZE - 1))


def chat_bucket(choice: Column, index: Column) -> Column:
    """The bucket of a tool index within a choice; both unsigned, those beyond their bounds share the band."""
    mixed = let(F.struct(as_bits(choice).alias("c"), as_bits(index).alias("i")), lambda x: splitmix(splitmix(rotated(x["c"], 17).bitwiseXOR(multiply(x["i"], 0x9E3779B97F4A7C15)))))
    plain = (choice >= 0) & (choice < CHOICES) & (index >= 0) & (index < TOOLS)
    return F.when(plain, F.shiftleft(choice.cast("long"), 16) + index.cast("long")).otherwise(F.lit(BAND).cast("long") + mixed.bitwiseAND(BAND_SIZE - 1))
