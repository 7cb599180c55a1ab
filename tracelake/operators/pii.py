"""Personal data in text: recognition, checks, placeholders and their way back.

One pass of the union pattern writes every match between two private-use characters, group by group.
Splitting at them gives kinds, values and offsets in code points without Python.  Repetitions are
possessive and arrays are built block by block, so work stays linear on long texts.  Placeholders are
put in by one Arrow pass.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.hmac import hmac_sha256, value_hash
from ..functions.lookup import names_pattern
from ..functions.masks import mask_for_samples
from ..functions.scan import let, none, scan
from ..functions.validators import id_card_ok, ipv4_ok, ipv4_reserved, ipv6_reserved, luhn_ok, strip_ip_tail

#: What must stay as it is (placeholders and inline images), then the kinds in order of priority.
PROTECTED = r"__CRED_\d{4,}__|__PII_\d+_[0-9a-fA-F]{8}__|data:image/[^;\x00]+;base64,[A-Za-z0-9+/=\s]+"
PATTERNS = {
    "email": r"(?<![0-9A-Za-z_.+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![0-9A-Za-z_-]|\.(?:[0-9_.-]|[A-Za-z][0-9A-Za-z_.-]))",
    "phone": r"(?<!\d)(?:\+?86[\- ]?)?1[3-9]\d{9}(?!\d)",
    "id_card": r"(?<!\d)\d{17}[\dXx](?!\d)",
    "bank_card": r"(?<!\d)(?:(?:62|60|3[47])\d{11,17}|[45]\d{12,18})(?!\d)",
    "ipv4": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d)",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:[0-9a-fA-F]{0,4}+:){2,}+[0-9a-fA-F:.]*+(?![0-9A-Za-z:.])",
    "api_key": r"(?<![0-9A-Za-z-])(?:sk-(?:proj-|ant-)?[A-Za-z0-9_-]{16,}|gh[pous]_[A-Za-z0-9]{16,}|AKIA[0-9A-Z]{16})(?![0-9A-Za-z-])",
}
URL_NUMBER = r"(?i)[?&](?:id|order|sn|amount|uid|tid|no|num|count|page|limit|offset|ts|time|date|price|total|code2?)\s*=\s*\d{10,}"
TOKEN = r"__PII_\d+_[0-9a-f]{8}__"
_OPEN, _NEXT = "\ue000", "\ue001"
ONE_HIT = "struct<kind:string,value:string,start:int,end:int>"
#: Of what a text must hold a part for a pattern to match anywhere in it: texts and forms.  Every long number holds eleven digits.
NEEDED = ("@", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "AKIA"), ("[0-9]{11}", r"[0-9]\.[0-9]{1,3}\.[0-9]", ":[0-9a-fA-F]{0,4}:")
#: Values with these beginnings are placeholders and never registered.
TOKEN_MARKS = ("__PII_", "__CRED_")


def marked_hits(text: Column, patterns: dict[str, str]) -> Column:
    """(kind, value, start, end) of the matches of any pattern, left to right; patterns hold no groups of their own."""
    union = "|".join(f"({p})" for p in patterns.values())
    marks = _OPEN + "".join(f"${i}{_NEXT}" for i in range(1, len(patterns) + 1))
    n = len(patterns)

    def step(pos: Column, part: Column) -> tuple[Column, Column]:
        fields = F.split(part, _NEXT, n + 1)
        kind = reduce(lambda w, ik: w.when(F.get(fields, ik[0]) != "", ik[1]), list(enumerate(patterns))[1:], F.when(F.get(fields, 0) != "", next(iter(patterns))))
        value = F.concat(*[F.get(fields, i) for i in range(n)])
        hit = F.struct(kind.alias("kind"), value.alias("value"), pos.alias("start"), (pos + F.length(value)).alias("end"))
        return pos + F.length(part) - n, F.array(hit)

    def found(parts: Column) -> Column:
        later = scan(F.slice(parts, F.lit(2), F.size(parts)), F.length(F.get(parts, 0)), step, ONE_HIT)
        return F.when(F.size(parts) > 1, later).otherwise(none(ONE_HIT))

    clean = F.translate(text, _OPEN + _NEXT, "\ufffd\ufffd")
    return let(F.split(F.regexp_replace(clean, F.lit(union), F.lit(marks)), _OPEN, -1), found)


def raw_hits(text: Column) -> Column:
    """Matches of the union pattern, before any check; cheap tests spare most texts the pass."""
    possible = reduce(lambda a, b: a | b, [*(text.contains(t) for t in NEEDED[0]), *(text.rlike(t) for t in NEEDED[1])])
    with_mail = marked_hits(text, {"protected": PROTECTED, **PATTERNS})
    without = marked_hits(text, {"protected": PROTECTED, **{k: p for k, p in PATTERNS.items() if k != "email"}})
    return F.when(~possible, none(ONE_HIT)).when(text.contains("@"), with_mail).otherwise(without)


def custom_hits(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Hits of the users' own patterns, rule by rule; of equal spans the first rule's stays."""
    each = [marked_hits(text, {name: f"(?:{pattern})"}) for name, pattern in rules]
    if not each:
        return none(ONE_HIT)
    ordered = F.transform(F.concat(*each), lambda h, i: F.struct(h["start"].alias("start"), h["end"].alias("end"), i.alias("i"), h.alias("h")))

    def firsts(a: Column) -> Column:
        before = lambda i: F.get(a, i - 1)
        same = lambda x, i: F.coalesce((before(i)["start"] == x["start"]) & (before(i)["end"] == x["end"]), F.lit(False))
        return F.transform(F.filter(F.filter(a, lambda x, i: ~same(x, i)), lambda x: x["h"]["value"] != ""), lambda x: x["h"])

    return let(F.array_sort(ordered), firsts)


def hardened(text: Column, hits: Column) -> Column:
    """Hits without numbers that touch an ASCII letter or digit, and without addresses with a zero before an octet."""

    def kept(h: Column) -> Column:
        around = F.concat(F.substring(text, h["start"], F.when(h["start"] > 0, 1).otherwise(0)), F.lit(" "), F.substring(text, h["end"] + 1, F.lit(1)))
        number = h["kind"].isin("phone", "id_card", "bank_card", "ipv4")
        return ~(number & around.rlike("[0-9A-Za-z]")) & ~((h["kind"] == "ipv4") & h["value"].rlike(r"(?:^|\.)0[0-9]"))

    return F.filter(hits, kept)


def ipv6_ok(value: Column) -> Column:
    """Eight groups of up to four hexadecimal digits; one ``::`` may stand for some; IPv4 may end it."""
    plain = F.regexp_replace(value, r"(?<=:)(?:\d{1,3}\.){3}\d{1,3}$", "0:0")
    groups = F.filter(F.split(plain, ":", -1), lambda g: g != "")
    short = plain.contains("::")
    sound = plain.rlike(r"^[0-9A-Fa-f:]+$") & F.forall(groups, lambda g: F.length(g) <= 4) & ~plain.rlike(r":::|::.*::|^:[^:]|[^:]:$")
    return sound & F.when(short, F.size(groups) <= 7).otherwise(F.size(groups) == 8)


def checked_hits(text: Column, raw: Column) -> Column:
    """Hits whose value passes the check of its kind; tails of addresses are cut off."""

    def trimmed(h: Column) -> Column:
        value = F.when(h["kind"].isin("ipv4", "ipv6"), strip_ip_tail(h["value"])).otherwise(h["value"])
        return F.struct(h["kind"].alias("kind"), value.alias("value"), h["start"].alias("start"), (h["start"] + F.length(value)).alias("end"))

    def good(h: Column) -> Column:
        kind, value = h["kind"], h["value"]
        before = F.greatest(h["start"] - 64, F.lit(0))
        context = F.substring(text, before + 1, h["end"] + 16 - before)
        return (
            F.when(kind == "protected", False)
            .when(kind == "bank_card", luhn_ok(value) & ~context.rlike(URL_NUMBER))
            .when(kind == "id_card", id_card_ok(value))
            .when(kind == "ipv4", ipv4_ok(value) & ~ipv4_reserved(value))
            .when(kind == "ipv6", ipv6_ok(value) & ~ipv6_reserved(value))
            .otherwise(True)
        )

    return F.filter(F.transform(raw, trimmed), good)


def with_hits(documents: DataFrame, text: str = "text", rules: list[tuple[str, str]] = (), names: list[tuple[str, str]] = (), strict: bool = False) -> DataFrame:
    """The rows with ``pii_hits``: built-in kinds, then the users' names and patterns, all hits; a null text has none."""
    given = F.coalesce(F.col(text), F.lit(""))
    found = let(raw_hits(given), lambda raw: checked_hits(given, raw))
    own = [custom_hits(given, list(rules))] if rules else []
    listed = [dictionary_hits(given, list(names), strict)] if names else []
    return documents.withColumn("pii_hits", F.concat(found, *listed, *own) if own or listed else found)


def dictionary_hits(text: Column, names: list[tuple[str, str]], strict: bool = False) -> Column:
    """Hits of (name, type) pairs that stand free; of several at a place the longest.

    A person's name may follow other writing but not be followed by it, unless ``strict``; all other
    types, and all types against ASCII letters and digits, must stand alone.
    """
    kinds: dict[str, list[str]] = {}
    for name, kind in names:
        kinds.setdefault(kind, []).append(name)
    wide = r"\u3400-\u9fff\uf900-\ufaff\u3040-\u30ff\uac00-\ud7af"

    def free(kind: str) -> str:
        person = kind in ("name", "person")
        before = f"0-9A-Za-z{wide}" if person and strict else "0-9A-Za-z"
        after = f"0-9A-Za-z{wide}" if person and strict else wide if person else "0-9A-Za-z"
        return rf"(?<![{before}])(?:{names_pattern(kinds[kind])})(?![{after}])"

    return arbitrate(F.concat(*[marked_hits(text, {kind: free(kind)}) for kind in kinds]))


def arbitrate(hits: Column) -> Column:
    """Of overlapping hits the earlier one stays; of equal starts the longer one."""
    ordered = F.array_sort(hits, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))

    def step(end: Column, h: Column) -> tuple[Column, Column]:
        return F.greatest(end, F.when(h["start"] >= end, h["end"])), F.when(h["start"] >= end, F.array(h)).otherwise(none(ONE_HIT))

    return F.when(F.size(hits) > 1, scan(ordered, F.lit(-1), step, ONE_HIT)).otherwise(hits)


def placed_hits(text: str, scope: str | None, hits: list[dict], salt: bytes) -> tuple[str, dict[str, str], int]:
    """(text with placeholders, value to placeholder, hits replaced)."""
    tokens: dict[str, str] = {}
    out, done = [], 0
    for h in hits:
        value = h["value"]
        if any(mark in value for mark in TOKEN_MARKS):
            continue
        if value not in tokens:
            message = value if scope is None else f"{scope}\x1f{value}"
            tokens[value] = f"__PII_{len(tokens) + 1}_{hmac.new(salt, message.encode(), hashlib.sha256).hexdigest()[:8]}__"
        out += [text[done : h["start"]], tokens[value]]
        done = h["end"]
    return "".join(out) + text[done:], tokens, len(out) // 2


def redact(documents: DataFrame, salt: bytes, scope: str = "doc_id", text: str = "text", **own: object) -> DataFrame:
    """Text with placeholders, the map back, and how many hits were new or seen before in the scope.

    Placeholders are numbered by first occurrence; their suffix is an HMAC of scope and value, so a
    repeated run gives the same text.  Values that look like placeholders stay.  ``own`` are the
    users' rules and names of ``with_hits``.
    """
    rows = with_hits(documents, text, **own)
    ready = rows.withColumns({"_t": F.col(text), "_s": F.col(scope).cast("string"), "_h": arbitrate(F.col("pii_hits"))})
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("redacted string, placeholders map<string,string>, n_new bigint, n_seen bigint").fields])
    kept = len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(low, 500) for b in batches for low in range(0, b.num_rows, 500)):
            given = zip(*(b.column(kept + i).to_pylist() for i in range(3)))
            made = [(None, {}, 0) if t is None else placed_hits(t, of, hits, salt) for t, of, hits in given]
            maps = pa.array([[(token, value) for value, token in tokens.items()] for _, tokens, _ in made], pa.map_(pa.string(), pa.string()))
            new = [len(tokens) for _, tokens, _ in made]
            columns = [pa.array([m[0] for m in made], pa.string()), maps, pa.array(new, pa.int64()), pa.array([m[2] - n for m, n in zip(made, new)], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], *columns], schema.names)

    return ready.mapInArrow(run, schema)


def prescan(text: Column, rules: list[tuple[str, str]], salt: bytes, scope: Column | None = None) -> Column:
    """Values that the users' patterns find in a raw body, each once, with the placeholder that it gets.

    Numbered by first occurrence, rule by rule; values that look like placeholders get none.
    """
    shaped = lambda v: v.contains(TOKEN_MARKS[0]) | v.contains(TOKEN_MARKS[1])
    values = F.filter(F.array_distinct(F.transform(custom_hits(F.coalesce(text, F.lit("")), rules), lambda h: h["value"])), lambda v: (v != "") & ~shaped(v))
    message = lambda v: v if scope is None else F.concat(scope.cast("string"), F.lit("\x1f"), v)
    token = lambda v, i: F.concat(F.lit("__PII_"), (i + 1).cast("string"), F.lit("_"), F.substring(hmac_sha256(salt, message(v)), 1, 8), F.lit("__"))
    return let(values, lambda vs: F.map_from_arrays(vs, F.transform(vs, token)))


def restore(text: Column, placeholders: Column) -> Column:
    """Known placeholders become their values again; unknown ones stay.

    A placeholder's number is its place in the map, so looking it up takes one step.
    """
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))

    def value(t: Column, keys: Column, held: Column) -> Column:
        place = F.regexp_extract(t, r"_([0-9]{1,9})_[0-9a-f]{8}__$", 1).try_cast("int") - 1
        return F.coalesce(F.when(F.get(keys, place) == t, F.get(held, place)), F.when(F.get(keys, place).isNull() | (F.get(keys, place) != t), F.try_element_at(placeholders, t)), t)

    def filled(m: Column) -> Column:
        values = F.transform(found, lambda t: value(t, m["k"], m["v"]))
        return F.array_join(F.zip_with(F.split(text, TOKEN, -1), F.concat(values, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")

    none_known = F.coalesce(placeholders, F.create_map().cast("map<string,string>"))
    return let(F.struct(F.map_keys(none_known).alias("k"), F.map_values(none_known).alias("v")), filled)


def samples(hits: DataFrame, key: bytes | None = None, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """Masked samples: hits by kind, value hash and the columns ``by``."""
    each = hits.select(*by, F.explode("pii_hits").alias("h"))
    masked = each.select(*by, F.col("h.kind").alias("kind"), value_hash(F.col("h.value"), key).alias("hash"), mask_for_samples(F.col("h.kind"), F.col("h.value")).alias("mask"))
    return masked.groupBy(*by, "kind", "hash").agg(F.count("*").alias("hits"), F.max("mask").alias("mask"))


def sample_maps(found: DataFrame) -> DataFrame:
    """One JSON object a kind: each mask with its count and hash; of values with one mask the greatest (hits, hash) stands.

    ``found`` is (kind, hash, hits, mask).  Masks say little, so there are few of a kind, but their number
    is not bounded by that; a kind's object is one row.
    """
    one = found.groupBy("kind", "mask").agg(F.max(F.struct("hits", "hash")).alias("v"))
    entry = F.struct("mask", F.struct(F.col("v.hits").alias("count"), F.col("v.hash").alias("hash")).alias("v"))
    return one.groupBy("kind").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("samples"))


def count_by_kind(hits: DataFrame) -> DataFrame:
    return hits.select(F.explode("pii_hits").alias("h")).groupBy(F.col("h.kind").alias("kind")).agg(F.count("*").alias("hits"))
