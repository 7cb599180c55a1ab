"""Credentials in texts, JSON bodies, and texts for the audit log."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.lookup import names_pattern
from ..functions.text import truncate_marked
from ..functions.jsonspan import DEPTH as JSON_DEPTH
from ..functions.jsonspan import rewritten
from .pii import TOKEN_MARKS, arbitrate, placed_hits, with_hits

_MARK, _LEAF = "", "\x00"
_GIVEN, _LONG_NUMBER = re.compile(f"[^{_LEAF}]+"), re.compile("[0-9]{10}")
#: Characters between leaves, no fewer than a check looks at around a hit.
_APART = 64
#: What the audit log shows in place of secrets, in order, and its longest text.
LOG_RULES = (
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED:private_key]"),
    (r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]+", "$1[REDACTED:bearer]"),
    (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[REDACTED:bearer]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[REDACTED:email]"),
    (r"\b[0-9]{17}[0-9Xx]\b", "[REDACTED:id_card]"),
    (r"\b1[3-9][0-9]{9}\b", "[REDACTED:phone]"),
    (r"(?:sk-|ghp_|gho_|AKIA)[A-Za-z0-9_-]+", "[REDACTED:secret]"),
    (r"(?i)\b((?:password|passwd|secret|token|api_key)\s*[=:]\s*)[^\s,;&]+", "$1[REDACTED:*]"),
)
LOG_LENGTH = 4096


def for_log(text: Column) -> Column:
    """A text for the audit log: no control characters, secrets masked, 4096 characters at most."""
    cleaned = F.regexp_replace(text, r"[\x00-\x1f\x7f-\x9f]", "")
    return truncate_marked(reduce(lambda c, r: F.regexp_replace(c, F.lit(r[0]), F.lit(r[1])), LOG_RULES, cleaned), LOG_LENGTH)


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]) if pairs else F.create_map().cast("map<string,string>")


def replace_credentials(text: Column, vault: dict[str, str]) -> Column:
    """Secrets (a bounded vault of secret to token) as tokens: one pass, the longest at each place, nothing scanned twice."""
    pieces = F.split(F.regexp_replace(F.translate(text, _MARK, "�"), F.lit(names_pattern(list(vault))), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.element_at(_table(vault), p)).otherwise(p)), "")


def restore_credentials(text: Column, vault: Column, minted: Column) -> Column:
    """Tokens as secrets again, but only those that this request minted itself."""
    token = "__CRED_[0-9]{4,}__"
    found = F.regexp_extract_all(text, F.lit(token), F.lit(0))
    values = F.transform(found, lambda t: F.when(F.array_contains(minted, t), F.coalesce(F.try_element_at(vault, t), t)).otherwise(t))
    return F.array_join(F.zip_with(F.split(text, token, -1), F.concat(values, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def _leaves(text: str) -> list[str]:
    found: list[str] = []

    def take(leaf: str) -> str:
        found.append(leaf.replace(_LEAF, "�"))
        return leaf

    rewritten(text, take, JSON_DEPTH)
    return found


def _joined(text: str) -> str:
    """The different leaves of a body that are not empty.  Around long numbers marks keep them so far apart that
    no check of a hit sees another leaf."""
    out, before = [], False
    for leaf in filter(None, dict.fromkeys(_leaves(text))):
        number = bool(_LONG_NUMBER.search(leaf))
        out += [_LEAF * (_APART if number or before else 1) if out else "", leaf]
        before = number
    return "".join(out)


def _replaced(body: str, joined: str, scope: str | None, hits: list[dict], salt: bytes) -> tuple[str, dict[str, str], int]:
    """(body with placeholders, value to placeholder, hits replaced), each leaf counted as often as it stands there."""
    placed, tokens, _ = placed_hits(joined, scope, hits, salt)
    if not tokens and _LEAF not in body and "u0000" not in body:
        return body, tokens, 0
    given = list(_GIVEN.finditer(joined))
    made = dict(zip((g[0] for g in given), _GIVEN.findall(placed), strict=True))
    ends = [g.end() for g in given]
    within = Counter(given[bisect_right(ends, h["start"])][0] for h in hits if not any(mark in h["value"] for mark in TOKEN_MARKS))
    found = 0

    def take(leaf: str) -> str:
        nonlocal found
        leaf = leaf.replace(_LEAF, "�")
        found += within[leaf]
        return made.get(leaf, leaf)

    return rewritten(body, take, JSON_DEPTH), tokens, found


def _mapped(rows: DataFrame, out: str, columns: tuple[str, ...], one: Callable[..., str]) -> DataFrame:
    """The rows with a text column ``out`` made of others, in one Arrow pass; null where the first is null."""
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(f"{out} string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(low, 500) for b in batches for low in range(0, b.num_rows, 500)):
            given = zip(*(b.column(c).to_pylist() for c in columns))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if g[0] is None else one(*g) for g in given], pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


def redact_json(rows: DataFrame, salt: bytes, scope: str, body: str = "body", **own: object) -> DataFrame:
    """Bodies whose strings and keys hold placeholders, as JSON that still parses; other bodies as plain texts.

    JSON inside strings is entered too.  All strings of a body share one numbering; equal ones are searched once.
    """
    joined = _mapped(rows, "_leaves", (body,), _joined)
    found = with_hits(joined, "_leaves", **own)
    ready = found.select(*rows.columns, F.col(body).alias("_t"), "_leaves", F.col(scope).cast("string").alias("_s"), arbitrate(F.col("pii_hits")).alias("_h"))
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("placeholders map<string,string>, n_new bigint, n_seen bigint, redacted string").fields])
    kept = len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(low, 500) for b in batches for low in range(0, b.num_rows, 500)):
            given = zip(*(b.column(kept + i).to_pylist() for i in range(4)))
            made = [(None, {}, 0) if t is None else _replaced(t, leaves, of, hits, salt) for t, leaves, of, hits in given]
            maps = pa.array([[(token, value) for value, token in tokens.items()] for _, tokens, _ in made], pa.map_(pa.string(), pa.string()))
            new = [len(tokens) for _, tokens, _ in made]
            columns = [maps, pa.array(new, pa.int64()), pa.array([m[2] - n for m, n in zip(made, new)], pa.int64()), pa.array([m[0] for m in made], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], *columns], schema.names)

    return ready.mapInArrow(run, schema)


def registered_entries(given: Column) -> Column:
    """What a registration may touch, as a map of entries to fields, from an object, a list or one name."""
    fields = lambda v: F.when(v.startswith("["), F.from_json(v, "array<string>")).when(v == "", F.expr("cast(array() as array<string>)")).otherwise(F.array(v))
    whole = F.transform_values(F.from_json(given, "map<string,string>"), lambda k, v: fields(F.coalesce(v, F.lit(""))))
    names = F.when(given.startswith("["), F.array_distinct(F.from_json(given, "array<string>"))).otherwise(F.array(given))
    return F.when(given.startswith("{"), whole).otherwise(F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.expr("cast(array() as array<string>)")))))


def parsed_mode(given: Column) -> Column:
    """allow, deny or pending from the words, the older ones or a boolean; null for anything else."""
    word = F.lower(F.trim(given))
    return F.when(word.isin("allow", "auto", "true"), "allow").when(word.isin("deny", "false"), "deny").when(word.isin("pending", "manual"), "pending")


__all__ = ["for_log", "parsed_mode", "redact_json", "registered_entries", "replace_credentials", "restore_credentials"]
