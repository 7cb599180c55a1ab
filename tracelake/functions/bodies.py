"""Request bodies, headers and placeholders: small rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hmac import hmac_sha256
from .scan import let, scan

#: Headers that concern one hop only.
HOP_HEADERS = ("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
#: What separates joined credentials and the parts of a key.
CREDENTIAL_MARK, PART_MARK = "\x1e", "\x1f"

#: Stands for a found part while a text is split; a text's own become replacement characters.
SPAN_MARK = "\ue002"


def streamed(body: Column) -> Column:
    """Whether the body asks for a stream: ``true`` and nothing like it."""
    return F.coalesce(F.from_json(body, "stream boolean")["stream"], F.lit(False)) & body.rlike(r'"stream"\s*:\s*true')


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else; an object with a doubled key does not count."""
    whole = F.try_parse_json(F.concat(F.lit('{"value":'), text, F.lit(',"closed here":true}')))
    return F.coalesce(F.try_variant_get(whole, "$['closed here']", "boolean"), F.lit(False))


def guarded(given: Column, made: Column) -> Column:
    """What was made, unless the given text was JSON and it is not."""
    return F.when(is_json(given) & ~is_json(made), given).otherwise(made)


def same_shape(given: Column, made: Column, paths: tuple[str, ...]) -> Column:
    """Whether restored JSON parses and the JSON texts in its strings (``paths``) still do."""
    inner = [~is_json(F.get_json_object(given, p)) | is_json(F.get_json_object(made, p)) for p in paths]
    whole = ~is_json(given) | is_json(made)
    for i in inner:
        whole = whole & F.coalesce(i, F.lit(True))
    return whole


def has_placeholder(text: Column) -> Column:
    return F.coalesce(text.contains("__PII_") | text.rlike("__CRED_[0-9]{6}"), F.lit(False))


def token_forms(text: Column) -> Column:
    """Everything that is written like a placeholder."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("__(?:CRED|PII)_[A-Za-z0-9_]*?[A-Za-z0-9]__"), F.lit(0))


def registrable(value: Column) -> Column:
    """Values that hold a placeholder's beginning are never registered."""
    return ~value.contains("__PII_") & ~value.contains("__CRED_")


def credential_token(number: Column, value: Column) -> Column:
    """``__CRED_000001__``; the value itself if it is shorter than four characters or looks like a token."""
    return F.when((F.length(value) < 4) | ~registrable(value), value).otherwise(F.format_string("__CRED_%06d__", number))


def occurrences(text: Column, part: Column) -> Column:
    """How often a part stands in a text, without overlaps."""
    return F.when(part == "", 0).otherwise(((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("bigint"))


def occurrence_spans(text: Column, part: Column) -> Column:
    """(start, end) of each place where a part stands in a text, left to right, without overlaps."""
    clean = F.translate(text, SPAN_MARK, "\ufffd")
    pieces = F.split(F.when(part == "", clean).otherwise(F.replace(clean, F.translate(part, SPAN_MARK, "\ufffd"), F.lit(SPAN_MARK))), SPAN_MARK, -1)

    def step(pos: Column, piece: Column) -> tuple[Column, Column]:
        start = pos + F.length(piece)
        return start + F.length(part), F.array(F.struct(start.alias("start"), (start + F.length(part)).alias("end")))

    return let(pieces, lambda ps: scan(F.slice(ps, F.lit(1), F.size(ps) - 1), F.lit(0), step, "struct<start:int,end:int>"))


def end_to_end(headers: Column, internal: str = "x-internal-") -> Column:
    """Headers (in small letters) without those of one hop, those that ``connection`` names, and the service's own."""
    named = F.transform(F.split(F.coalesce(F.try_element_at(headers, F.lit("connection")), F.lit("")), ","), lambda x: F.lower(F.trim(x)))
    return F.map_filter(headers, lambda k, v: ~F.lower(k).isin(*HOP_HEADERS) & ~F.array_contains(named, F.lower(k)) & ~F.lower(k).startswith(internal))


def first_header(headers: Column, names: tuple[str, ...]) -> Column:
    """The first header that is there and not blank."""
    return F.coalesce(*[F.when(F.trim(F.try_element_at(headers, F.lit(n))) != "", F.try_element_at(headers, F.lit(n))) for n in names])


def valid_session(value: Column) -> Column:
    return F.coalesce((value != "") & (F.octet_length(value) <= 256) & ~value.rlike(r"[\x00-\x1f\x7f]"), F.lit(False))


def valid_request_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[A-Za-z0-9._-]{1,64}\z"), F.lit(False))


def joined_credentials(values: Column) -> Column:
    """Credentials as one text: without empty ones, sorted, each once."""
    return F.array_join(F.array_distinct(F.array_sort(F.filter(values, lambda v: v != ""))), CREDENTIAL_MARK)


def tenant(key: bytes, base_url: Column, credentials: Column) -> Column:
    return hmac_sha256(key, F.concat(base_url, F.lit(PART_MARK), joined_credentials(credentials)))


def conversation_key(key: bytes, tenant_id: Column, protocol: Column, header: Column, cache_key: Column, earlier: Column, prefix: Column) -> Column:
    """Key of a conversation by the first of: an explicit header, the cache key (not of messages), the
    earlier response (of responses), the stable prefix; null if there is none."""
    chosen = F.coalesce(
        F.when(valid_session(header), F.concat(F.lit("header"), F.lit(PART_MARK), header)),
        F.when((protocol != "anthropic") & (cache_key != ""), F.concat(F.lit("cache"), F.lit(PART_MARK), cache_key)),
        F.when((protocol == "responses") & (earlier != ""), F.concat(F.lit("earlier"), F.lit(PART_MARK), earlier)),
        F.when(prefix.isNotNull(), F.concat(F.lit("prefix"), F.lit(PART_MARK), prefix)),
    )
    return F.when(chosen.isNotNull(), hmac_sha256(key, F.concat(tenant_id, F.lit(PART_MARK), chosen)))


def stable_prefix(tools: Column, system: Column, first_user: Column) -> Column:
    """Tools sorted by name, the system text and the first user text as JSON; null without a user text.

    ``tools`` is an array of structs with ``name`` first.
    """
    ordered = F.array_sort(F.coalesce(tools, F.array()))
    return F.when(first_user.isNotNull(), F.to_json(F.struct(ordered.alias("tools"), F.coalesce(system, F.lit("")).alias("system"), first_user.alias("user"))))


def outcome(kind: Column, status: Column) -> Column:
    """(status, error_kind) of the log for what became of a request."""
    failed = kind.isin("no_upstream", "pii_unavailable", "empty_body", "non_json", "oversize")
    code = F.when(failed, 502).when(kind == "bad_request", 400).otherwise(status).cast("int")
    return F.struct(code.alias("status"), F.when(failed | (kind == "bad_request"), kind).when(status >= 400, "upstream_status").alias("error_kind"))
