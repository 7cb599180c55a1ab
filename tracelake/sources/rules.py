"""Rule, policy and registry files: small ones (1 MiB at most), read through Spark's file systems."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import replace
from typing import Any

from py4j.protocol import Py4JError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import Policy

LIMIT = 1 << 20
MODES = ("off", "block", "approve")
#: Keys of a policy file and the fields that they fill.
POLICY_KEYS = {"deny": "deny", "extra_block_substrings": "block", "extra_sensitive_paths": "paths", "internal_suffixes": "internal", "dangerous": "dangerous"}
#: Names that a user's rule may not take.
BUILT_IN = ("email", "phone", "id_card", "bank_card", "ipv4", "ipv6", "api_key", "protected")


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """One name per line; ``#`` starts a comment anywhere; blank lines are skipped."""
    line = F.trim(F.substring_index("value", "#", 1))
    return spark.read.text(path).select(line.alias("name")).filter("name <> ''")


def small_text(spark: SparkSession, path: str) -> str:
    """The text of one small file; its size is known before it is read."""
    files = spark.read.format("binaryFile").load(path)
    sizes = files.select("length").take(2)
    if len(sizes) != 1 or sizes[0].length > LIMIT:
        raise ValueError(f"{path}: one file of at most {LIMIT} bytes is expected")
    return bytes(files.select("content").first().content).decode("utf-8-sig")


def _parsed(text: str) -> Any:
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def load_rules(spark: SparkSession, path: str, kind: str = "patterns") -> list[tuple[str, str]]:
    """(name, pattern) or (name, type) pairs of a JSON or YAML file; a dictionary may also be TXT.

    Fails on a file over the limit, on one that does not parse and on entries of another shape.
    """
    if path.endswith(".txt"):
        if kind != "dict":
            raise ValueError("only a dictionary may be a text file")
        lines = (x.split("#")[0].strip() for x in small_text(spark, path).splitlines())
        return [(x, "name") for x in lines if x]
    value = _parsed(small_text(spark, path))
    if isinstance(value, dict):
        value = value.get(kind, value.get("names" if kind == "dict" else "rules", []))
    if not isinstance(value, list):
        raise ValueError(f"{path}: a list is expected")
    second = "type" if kind == "dict" else "pattern"
    pairs = []
    for item in value:
        if isinstance(item, str) and kind == "dict":
            pairs.append((item, "name"))
        elif isinstance(item, dict) and isinstance(item.get("name"), str) and (kind == "dict" or isinstance(item.get(second), str)):
            pairs.append((item["name"], str(item.get(second, "name"))))
        else:
            raise ValueError(f"{path}: entry {item!r}")
    return pairs


def _runs(spark: SparkSession, pattern: str) -> bool:
    """Whether the engine that will run a pattern takes it."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JError, IllegalArgumentException):
        return False
    return True


def checked_patterns(pairs: list[tuple[str, str]], taken: tuple[str, ...] = BUILT_IN, spark: SparkSession | None = None) -> list[tuple[str, str]]:
    """The pairs whose names are new and whose patterns compile, without ``\\b`` or groups that capture.

    With a session they must also compile where they will run, so that none fails a job later.
    """
    seen, kept = set(taken), []
    for name, pattern in pairs:
        try:
            compiled = re.compile(pattern)
        except re.error:
            continue
        if spark is not None and not _runs(spark, pattern):
            continue
        if name not in seen and r"\b" not in pattern and not compiled.groups:
            seen.add(name)
            kept.append((name, pattern))
    return kept


def literal_prefix(pattern: str) -> str:
    """Characters that every match of a pattern begins with; empty where that is not plain to see."""
    if "|" in pattern or not (m := re.match(r"(?:[A-Za-z0-9 _@:/=-]|\\[^A-Za-z0-9])+", pattern)):
        return ""
    plain, rest = m[0], pattern[m.end() :]
    if rest[:1] in ("?", "*", "{"):
        plain = re.sub(r"(?:\\.|.)$", "", plain)
    return re.sub(r"\\(.)", r"\1", plain)


def _dangerous(item: Any) -> tuple[str, str, bool]:
    """``pattern => reason [network]`` or an object with these names."""
    if isinstance(item, str) and "=>" in item:
        pattern, _, reason = item.partition("=>")
        network = reason.rstrip().endswith("[network]")
        return pattern.strip(), reason.rstrip().removesuffix("[network]").strip(), network
    if isinstance(item, dict) and isinstance(item.get("pattern"), str) and not set(item) - {"pattern", "reason", "network"}:
        return item["pattern"], str(item.get("reason", "")), bool(item.get("network", False))
    raise ValueError(f"dangerous: {item!r}")


def load_policy(spark: SparkSession, path: str, mode: str | None = None) -> tuple[Policy, str]:
    """(policy, mode) of a JSON or YAML file.  A mode given here comes first, then the file's, then off.

    Unknown keys, unknown modes and entries of another shape are errors.
    """
    value = _parsed(small_text(spark, path))
    if not isinstance(value, dict):
        raise ValueError(f"{path}: an object is expected")
    if unknown := set(value) - {*POLICY_KEYS, "allow", "mode"}:
        raise ValueError(f"{path}: unknown keys {sorted(unknown)}")
    policy = Policy()
    for key, field in POLICY_KEYS.items():
        items = value.get(key) or []
        if not isinstance(items, list) or not all(isinstance(x, str) or field == "dangerous" for x in items):
            raise ValueError(f"{path}: {key} must be a list of texts")
        policy = replace(policy, **{field: tuple(_dangerous(x) if field == "dangerous" else x for x in items)})
    chosen = mode or value.get("mode") or "off"
    if chosen not in MODES:
        raise ValueError(f"{path}: mode {chosen!r}")
    return policy, chosen


def _digest(entries: list[dict]) -> str:
    return hashlib.sha256(json.dumps(entries, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def registry_text(callers: DataFrame) -> str:
    """Callers (a bounded table) as a registry file: entries by path and their SHA-256.  A larger table is an error, see ``write_registry``."""
    rows = callers.orderBy("caller_path").select(F.to_json(F.struct("*"))).limit(LIMIT // 16 + 1).collect()
    if len(rows) > LIMIT // 16:
        raise ValueError(f"more than {LIMIT // 16} callers: use write_registry")
    entries = [json.loads(r[0]) for r in rows]
    return json.dumps({"entries": entries, "sha256": _digest(entries)}, indent=2, ensure_ascii=False)


def _lines_digest(lines: DataFrame) -> tuple[int, str]:
    """Number of lines, and the sum of their SHA-256 in four words modulo 2**64, whatever their order."""
    word = lambda k: F.conv(F.substring(F.sha2("value", 256), 16 * k + 1, 16), 16, 10).cast("decimal(20,0)")
    row = lines.agg(F.count("*"), *[F.sum(word(k)) for k in range(4)]).first()
    return row[0], "".join(f"{int(v or 0) % (1 << 64):016x}" for v in row[1:])


def write_registry(callers: DataFrame, path: str) -> None:
    """Any number of callers as JSON lines in a folder, with their number and a digest beside them."""
    callers.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path}/entries")
    spark = callers.sparkSession
    number, digest = _lines_digest(spark.read.text(f"{path}/entries"))
    spark.range(1).select(F.lit(json.dumps({"entries": number, "digest": digest})).alias("value")).coalesce(1).write.text(f"{path}/digest")


def read_registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Callers of a folder that ``write_registry`` made; an entry more, less or changed is an error."""
    lines = spark.read.text(f"{path}/entries")
    said = json.loads(small_text(spark, f"{path}/digest"))
    if (said["entries"], said["digest"]) != _lines_digest(lines):
        raise ValueError(f"{path}: the digest does not fit the entries")
    return lines.select(F.from_json("value", schema).alias("e")).select("e.*")


def load_registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Callers of a registry file.  A list, or an object by path, is the old format and has no digest."""
    value = _parsed(small_text(spark, path))
    if isinstance(value, dict) and "entries" in value:
        entries = value["entries"]
        if value.get("sha256") != _digest(entries):
            raise ValueError(f"{path}: the digest does not fit the entries")
    elif isinstance(value, dict):
        entries = [{"caller_path": k, **v} for k, v in value.items()]
    else:
        entries = value
    return spark.createDataFrame([(json.dumps(e),) for e in entries], "e string").select(F.from_json("e", schema).alias("e")).select("e.*")
