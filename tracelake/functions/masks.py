"""Masks of personal values.  The two families differ in aliases and short forms; keep them apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ends(value: Column, first: int, last: int) -> Column:
    return F.concat(F.substring(value, 1, first), F.lit("****"), F.substring(value, -last, last))


def _short(value: Column) -> Column:
    n = F.length(value)
    return F.when(n < 2, F.lit("***")).when(n < 6, _ends(value, 1, 1)).otherwise(_ends(value, 3, 3))


def _email(value: Column) -> Column:
    domain = F.regexp_extract(value, r"(?s)@(.*)\z", 1)
    suffix = F.substring_index(domain, ".", -1)
    return F.when(domain.contains(".") & (suffix != ""), F.concat(F.lit("***@***."), suffix)).otherwise(F.lit("***@***"))


def _ipv4(value: Column, otherwise: Column) -> Column:
    parts = F.split(value, r"\.", -1)
    return F.when(F.size(parts) == 4, F.concat(F.get(parts, 0), F.lit("."), F.get(parts, 1), F.lit(".**.**"))).otherwise(otherwise)


def mask_for_model(kind: Column, value: Column) -> Column:
    """The mask that a language model sees."""
    n, k = F.length(value), F.lower(kind)
    long = F.when(n >= 8, _ends(value, 4, 4))
    out = (
        F.when(n == 0, F.lit("***"))
        .when((k == "phone") & (n >= 7), _ends(value, 3, 4))
        .when((k == "email") & value.contains("@"), _email(value))
        .when(k.isin("bank_card", "bankcard", "id_card") & (n >= 4), F.concat(F.lit("**** **** **** "), F.substring(value, -4, 4)))
        .when(k == "ipv4", _ipv4(value, long.when(n >= 2, _ends(value, 1, 1)).otherwise(F.lit("***"))))
        .when(k.isin("ipv6", "api_key", "apikey") & (n >= 8), _ends(value, 4, 4))
        .otherwise(_short(value))
    )
    return F.substring(out, 1, 64)


def mask_for_samples(kind: Column, value: Column) -> Column:
    """The mask that is kept with samples."""
    n, k = F.length(value), F.lower(kind)
    brief = F.when(n >= 2, _ends(value, 1, 1)).otherwise(F.lit("***"))
    out = (
        F.when(n == 0, F.lit("***"))
        .when((k == "phone") & (n >= 7), _ends(value, 3, 4))
        .when((k == "email") & value.contains("@"), _email(value))
        .when(k.isin("bank", "bank_card"), F.when(n >= 4, F.concat(F.lit("**** **** **** "), F.substring(value, -4, 4))).otherwise(brief))
        .when(k == "ipv4", _ipv4(value, F.when(n >= 8, _ends(value, 4, 4)).otherwise(brief)))
        .when(k.isin("ipv6", "api_key") & (n >= 8), _ends(value, 4, 4))
        .otherwise(_short(value))
    )
    return F.substring(out, 1, 64)
