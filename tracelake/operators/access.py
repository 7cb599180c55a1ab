"""Views and decisions over registered callers, command scopes and grants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .identity import EXPIRING_SOON, expires_at

#: Signs of a caller's state, and reactions with what they decide.
STATUS_SIGNS = ("❎", "✅", "⏳")
REACTIONS = {"♾": "approve_always", "✅": "demote_manual", "❎": "disable"}
#: Marks of a reason, in order, and the branch that they lead to.
BRANCHES = (
    (("hash_mismatch", "hash mismatch"), "credential"), (("register", "注册"), "register"), (("hash", "哈希"), "hash_change"), (("credential", "凭据"), "credential"),
    (("command", "命令"), "command"), (("audit", "审计"), "audit"),
)


def allow_mode(own: Column, automatic: Column, fallback: str) -> Column:
    return F.coalesce(own, automatic, F.lit(fallback))


def status_sign(revoked: Column, enabled: Column) -> Column:
    return F.when(revoked, STATUS_SIGNS[0]).when(enabled, STATUS_SIGNS[1]).otherwise(STATUS_SIGNS[2])


def registration_view(callers: DataFrame, fallback: str) -> DataFrame:
    """What the registration page shows; the time to live appears with the authorisation."""
    return callers.select(
        "caller_path", "name", status_sign(F.col("revoked"), F.col("enabled")).alias("status"), allow_mode(F.col("allow_mode"), F.col("auto_approve"), fallback).alias("mode"),
        short_hash(F.col("expected_hash")).alias("hash"), "authorized_at", F.when(F.col("authorized_at").isNotNull(), F.col("authorized_ttl_secs")).alias("ttl_secs"),
    )


def short_hash(value: Column) -> Column:
    """Eight characters of a hash, without the name of its kind."""
    return F.substring(F.regexp_replace(value, "^sha256:", ""), 1, 8)


def caller_label(path: Column, name: Column, description: Column, enrolled: Column) -> Column:
    shown = F.when(name != "", F.concat(name, F.lit("（"), path, F.lit("）"))).otherwise(path)
    return F.concat(shown, F.when(enrolled, "").otherwise("（未注册）"), F.when(description != "", F.concat(F.lit(" · "), description)).otherwise(""))


def health(callers: DataFrame, now: int) -> DataFrame:
    """Counts for the health page: waiting, usable and soon expiring callers."""
    ends = expires_at(F.col("authorized_at"), F.col("authorized_ttl_secs"))
    usable = F.col("enabled") & ~F.col("revoked")
    count = lambda flag: F.count_if(F.coalesce(flag, F.lit(False)))
    return callers.agg(
        count(~F.col("enabled") & ~F.col("revoked")).alias("pending"), count(usable).alias("enabled"), count(F.col("revoked")).alias("revoked"),
        count(usable & (ends > now) & (ends <= now + EXPIRING_SOON)).alias("expiring"),
    )


def credential_decision(outcome: Column, mode: Column, expired: Column, automatic: str) -> Column:
    """allow, deny or pending for a request whose caller was looked up with ``outcome``.

    A revoked caller is denied; an unknown one is denied or waits, whatever the automatic mode allows;
    a mismatched hash waits; an expired authorisation waits unless the mode denies.
    """
    return (
        F.when(outcome == "revoked", "deny")
        .when(outcome == "unknown", "deny" if automatic == "deny" else "pending")
        .when(outcome == "mismatch", "pending")
        .when(mode == "deny", "deny")
        .when(F.coalesce(expired, F.lit(False)), "pending")
        .otherwise(mode)
    )


def three_factors(caller_path: Column, caller_hash: Column, binary_hash: Column, expected_binary: str | None, secret: Column, expected_secret: str | None) -> Column:
    """Path and hash must be given; a binary hash and a secret only where the service expects one."""
    given = F.coalesce((F.trim(caller_path) != "") & (F.trim(caller_hash) != ""), F.lit(False))
    same = lambda value, want: F.lit(True) if not want else F.coalesce(value == want, F.lit(False))
    return given & same(binary_hash, expected_binary) & same(secret, expected_secret)


def reaction_outcome(reaction: Column) -> Column:
    """What a reaction decides, without its variation selector; null for any other."""
    key = normalize_reaction(F.trim(reaction))
    return F.coalesce(*[F.when(key == sign, F.lit(what)) for sign, what in REACTIONS.items()])


def normalize_reaction(key: Column) -> Column:
    return F.replace(key, F.lit("️"), F.lit(""))


def approval_branch(reason: Column) -> Column:
    """The branch of an approval by its reason; ``error`` for unlocking, which has none."""
    low = F.lower(reason)
    head = F.ltrim(low)
    out = F.when(head.startswith("unlock") | head.startswith("解锁"), "error").when(head.startswith("revoke") | head.startswith("吊销"), "revoke")
    for marks, branch in BRANCHES:
        out = out.when(F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: low.contains(m)), branch)
    return out.otherwise("unknown")


def listed(value: Column, whitelist: tuple[str, ...]) -> Column:
    """An empty list admits all."""
    return value.isin(*whitelist) if whitelist else F.lit(True)


def grants(approvals: DataFrame) -> DataFrame:
    """The set of (caller, command, host) that were granted, however often."""
    return approvals.select("caller_path", "command", "host").filter("caller_path is not null and command is not null").distinct()


def expanded_scopes(scopes: DataFrame, groups: DataFrame) -> DataFrame:
    """Hosts of each owner's scopes (owner, scope): a group's (grp, host) members, or the scope itself."""
    joined = scopes.join(groups, F.col("scope") == F.col("grp"), "left")
    return joined.groupBy("owner").agg(F.array_sort(F.collect_set(F.coalesce("host", "scope"))).alias("hosts"))


def command_allowed(calls: DataFrame, rules: DataFrame, groups: DataFrame) -> DataFrame:
    """Calls (caller_path, command, host) with ``allowed``: a rule (rule_caller, rule_command, scope) names
    the command or ``*`` and its scope, a host or a group, holds the host or is ``*``."""
    members = groups.select("grp", F.col("host").alias("member"))
    hosts = rules.join(members, F.col("scope") == F.col("grp"), "left").select("rule_caller", "rule_command", F.coalesce("member", "scope").alias("rule_host")).distinct()
    fits = (F.col("caller_path") == F.col("rule_caller")) & F.col("rule_command").isin("*", F.col("command")) & F.col("rule_host").isin("*", F.col("host"))
    keyed = calls.withColumn("_n", F.monotonically_increasing_id())
    return keyed.join(hosts, fits, "left").groupBy("_n", "caller_path", "command", "host").agg(F.max(F.col("rule_caller").isNotNull()).alias("allowed")).drop("_n")


def filled_arguments(template: Column, values: Column) -> Column:
    """``{name}`` by the map of values; unknown names stay."""
    parts = F.regexp_extract_all(template, F.lit(r"\{[^{}]*\}|[^{]+|\{"), F.lit(0))
    value = lambda p: F.coalesce(F.try_element_at(values, F.regexp_extract(p, r"^\{(.*)\}$", 1)), p)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\{[^{}]*\}$"), value(p)).otherwise(p)), "")


def parameter_error(kind: Column, choices: Column, value: Column) -> Column:
    """Why a parameter's value is refused; null if it is good."""
    return (
        F.when(value.isNull(), "missing")
        .when((kind == "enum") & ~F.coalesce(F.array_contains(choices, value), F.lit(False)), "not in the list")
        .when((kind == "integer") & ~value.rlike("^[0-9]+$"), "no integer")
        .when((kind == "string") & (F.length(value) > 4096), "too long")
        .when((kind == "string") & value.startswith("-"), "leading dash")
    )
