"""Text helpers: truncation with a marker, model names, summary redaction, partial tokens."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scan import let

#: Ordered (pattern, replacement) pairs of summary redaction.
SUMMARY_RULES = (
    (r"__CRED_[0-9]{4,}_*|__PII_[0-9]+_[0-9a-f]+_*", "[REDACTED:placeholder]"),
    (r"sk-(?:proj-|ant-)?[A-Za-z0-9_-]{8,}", "[REDACTED:api_key]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2}", "[REDACTED:email]"),
    (r"(?<![0-9A-Za-z_])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z_])", "[REDACTED:ipv4]"),
    (r"(?<![0-9A-Za-z_])[0-9]{17}[0-9Xx](?![0-9A-Za-z_])", "[REDACTED:id_card]"),
    (r"(?<![0-9A-Za-z_])[0-9]{13,19}(?![0-9A-Za-z_])", "[REDACTED:bank_card]"),
    (
        r'(?i)("?(?:password|passwd|pwd|secret|api[_-]?key|apikey|access[_-]?token|auth[_-]?token|client[_-]?secret)"?\s*[:=]\s*"?)[^",}\s][^",}]*',
        "$1[REDACTED:secret]",
    ),
)
#: What a text must hold for a rule to match, rule by rule.
SUMMARY_NEEDS: tuple[Callable[[Column], Column], ...] = (
    lambda t: t.contains("__CRED_") | t.contains("__PII_"), lambda t: t.contains("sk-"), lambda t: t.contains("@"), lambda t: t.rlike(r"[0-9]\.[0-9]{1,3}\.[0-9]"),
    lambda t: t.rlike("[0-9]{17}"), lambda t: t.rlike("[0-9]{13}"), lambda t: t.contains(":") | t.contains("="),
)
#: What is left of a placeholder that a stream has cut off.
PARTIAL_CREDENTIAL = r"__CRED(?!_\d{4,}__)(?:_\d*)?_?(?=\z|\s|[^\w])"
PARTIAL_PERSONAL = (
    r"__PI(?<!__CRED_\d{4,20}__PI)(?<!__PII_\d{1,20}_[0-9a-fA-F]{8}__PI)(?!I_\d+_[0-9a-f]{8}__)"
    r"(?:I(?:_\d+(?:_[0-9a-fA-F]*)?)?)?(?:_*\z|(?=\s|[^\w]))"
)


def truncate_marked(text: Column, n: int) -> Column:
    """The first ``n`` characters and a marker, if there are more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…[truncated]"))).otherwise(text)


def normalize_model(name: Column) -> Column:
    """Without control characters, 128 characters at most; ``unknown_model`` where nothing is left."""
    kept = F.substring(F.regexp_replace(name, r"[\x00-\x1f\x7f-\x9f]", ""), 1, 128)
    return F.when(F.coalesce(F.length(kept), F.lit(0)) == 0, F.lit("unknown_model")).otherwise(kept)


def redact_summary(text: Column) -> Column:
    """Control characters go (tab and line feed stay), then the rules apply in their order.

    Each rule has a cheap test of what its matches hold, as most texts need none.
    """
    cleaned = F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", "")

    def applied(c: Column, rule: tuple[tuple[str, str], Callable[[Column], Column]]) -> Column:
        (pattern, new), needed = rule
        return let(c, lambda x: F.when(needed(x), F.regexp_replace(x, F.lit(pattern), F.lit(new))).otherwise(x))

    return reduce(applied, zip(SUMMARY_RULES, SUMMARY_NEEDS), cleaned)


def summarize(text: Column, n: int = 1000) -> Column:
    return truncate_marked(redact_summary(text), n)


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


def strip_partial_tokens(text: Column) -> Column:
    """Placeholders cut off at their end are removed; whole ones and ordinary words stay."""
    once = F.regexp_replace(text, F.lit(PARTIAL_CREDENTIAL), F.lit(""))
    return F.regexp_replace(once, F.lit("(?U)" + PARTIAL_PERSONAL), F.lit(""))


def authority(url: Column) -> Column:
    """host:port of a URL, without user and password."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1)
