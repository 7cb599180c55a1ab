"""Who a request belongs to: sessions, callers, access and the expiry of authorisations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hmac import hmac_sha256

#: Sources of a session in order of priority; the first five name a session, the others a user.
SESSION_SOURCES = ("header", "conversation", "previous_response_id", "previous_message_id", "prompt_cache_key", "user_id", "safety_identifier", "user")
OLD_HASH_GRACE = 3_600
EXPIRING_SOON = 86_400


def session_source(columns: dict[str, Column]) -> tuple[Column, Column, Column]:
    """(value, source, scope) of the first source that is not blank."""
    given = {k: F.when(F.trim(columns[k]) != "", columns[k]) for k in SESSION_SOURCES if k in columns}
    value = F.coalesce(*given.values())
    source = reduce(lambda w, k: w.when(given[k].isNotNull(), k), list(given)[1:], F.when(next(iter(given.values())).isNotNull(), next(iter(given))))
    scope = F.when(source.isin(*SESSION_SOURCES[:5]), "session").when(source.isNotNull(), "user").otherwise("none")
    return value, source, scope


def session_digest(key: bytes | None, label: str, protocol: Column, raw: Column) -> Column:
    """Sixteen digits of an HMAC over label, protocol and raw value; null without a key."""
    if not key:
        return F.lit(None).cast("string")
    return F.when(raw.isNotNull(), F.substring(hmac_sha256(key, F.concat_ws("\x1f", F.lit(label), protocol, raw)), 1, 16))


def first_texts(conversations: DataFrame) -> DataFrame:
    """The system text and the first user text of each conversation."""
    first = lambda role: F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    return conversations.groupBy("conv_id").agg(first("system").alias("system_text"), first("user").alias("first_user_text"), F.count("*").alias("turns"))


def expires_at(authorized_at: Column, ttl: Column) -> Column:
    """Null if either is missing; a span of zero never ends."""
    return F.when(ttl > 0, authorized_at + ttl)


def resolve_callers(calls: DataFrame, callers: DataFrame, now: int) -> DataFrame:
    """Outcome of each call (caller_path, caller_hash): by path first, then by hash.

    The registry is joined twice by key; of several entries with a hash the first by path that is
    not revoked counts.
    """
    by_path = callers.select(
        F.col("caller_path").alias("p"), F.col("expected_hash").alias("p_hash"), F.col("old_hash").alias("p_old"), F.col("old_hash_expires_at").alias("p_until"), F.col("revoked").alias("p_revoked")
    )
    best = F.min(F.struct(F.col("revoked").cast("int").alias("r"), F.col("caller_path").alias("path")))
    by_hash = callers.groupBy(F.col("expected_hash").alias("h")).agg(best.alias("b")).select("h", (F.col("b.r") == 1).alias("h_revoked"), F.col("b.path").alias("h_path"))
    joined = calls.join(by_path, F.col("caller_path") == F.col("p"), "left").join(by_hash, F.col("caller_hash") == F.col("h"), "left")
    grace = (F.col("caller_hash") == F.col("p_old")) & (F.lit(now) <= F.col("p_until"))
    outcome = (
        F.when(F.col("p").isNotNull() & F.col("p_revoked"), "revoked")
        .when(F.col("p").isNotNull() & (F.col("caller_hash") == F.col("p_hash")), "enrolled")
        .when(F.col("p").isNotNull() & F.coalesce(grace, F.lit(False)), "grace")
        .when(F.col("p").isNotNull(), "mismatch")
        .when(F.col("h_path").isNotNull() & F.col("h_revoked"), "revoked")
        .when(F.col("h_path").isNotNull(), "moved")
        .otherwise("unknown")
    )
    return joined.select("caller_path", "caller_hash", outcome.alias("outcome"), F.coalesce("p", "h_path").alias("entry_path"))


def found_entries(keys: DataFrame, callers: DataFrame) -> DataFrame:
    """The entry (path) that each ``key`` means: a path, else the hash of an entry, else the name of an active one, else any name.

    Of several entries the least path counts.  The registry is joined three times by key.
    """
    by_path = callers.select(F.col("caller_path").alias("p"))
    by_hash = callers.groupBy(F.col("expected_hash").alias("h")).agg(F.min("caller_path").alias("h_path"))
    named = callers.filter("coalesce(name, '') <> ''").groupBy(F.col("name").alias("n"))
    by_name = named.agg(F.coalesce(F.min(F.when(~F.col("revoked"), F.col("caller_path"))), F.min("caller_path")).alias("n_path"))
    joined = keys.join(by_path, F.col("key") == F.col("p"), "left").join(by_hash, F.col("key") == F.col("h"), "left").join(by_name, F.col("key") == F.col("n"), "left")
    return joined.select(*[keys[c] for c in keys.columns], F.coalesce("p", "h_path", "n_path").alias("entry_path"))


def entry_allowed(entries: Column, entry: Column, field: Column) -> Column:
    """Access by a map of entries to fields: no map or entry denies, no field or an empty list allows."""
    fields = F.try_element_at(entries, entry)
    blank = F.coalesce(F.trim(field) == "", F.lit(True))
    return F.coalesce((F.trim(entry) != "") & fields.isNotNull() & (blank | (F.size(fields) == 0) | F.array_contains(fields, field)), F.lit(False))


def expiring_soon(callers: DataFrame, now: int) -> DataFrame:
    """Enabled callers whose authorisation ends within a day."""
    ends = expires_at(F.col("authorized_at"), F.col("authorized_ttl_secs"))
    return callers.filter(F.col("enabled") & ~F.col("revoked") & (ends > now) & (ends <= now + EXPIRING_SOON)).select("caller_path", ends.alias("expires_at"))


def latest_state(events: DataFrame, key: str, order: str) -> DataFrame:
    """State of each key after its last event."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return events.withColumn("_r", rank).filter("_r = 1").drop("_r")
