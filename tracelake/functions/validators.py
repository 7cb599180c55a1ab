"""Checks of recognised values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the seventeen digits and the check characters of an identity number.
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECKS = "10X98765432"
#: Beginnings of IPv4 addresses that are reserved; "172.2" also covers 172.2 and 172.200 to 172.255.
RESERVED_V4 = (
    "10.", "172.16.", "172.17.", "172.18.", "172.19.", "172.2", "172.30.", "172.31.", "192.168.", "192.88.99.", "127.", "169.254.", "192.0.0.", "192.0.2.", "198.51.100.",
    "203.0.113.", "198.18.", "198.19.", "0.",
)
#: Beginnings of IPv6 addresses that are reserved.
RESERVED_V6 = ("::", "fe80:", "fe9", "fea", "feb", "fc", "fd", "ff", "2001:db8:", "64:ff9b:")
IP_TAIL = ".,;)]}"


def luhn_ok(digits: Column) -> Column:
    """Luhn check; empty or other than digits is false."""
    return F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def id_card_ok(value: Column) -> Column:
    """Check character of an identity number of eighteen places."""
    total = sum((F.substring(value, i + 1, 1).try_cast("int") * w for i, w in enumerate(ID_WEIGHTS)), F.lit(0))
    check = F.substring(F.lit(ID_CHECKS), (total % 11 + 1).cast("int"), F.lit(1))
    return F.coalesce(value.rlike(r"^[0-9]{17}[0-9Xx]$") & (check == F.upper(F.substring(value, 18, 1))), F.lit(False))


def strip_ip_tail(value: Column) -> Column:
    return F.rtrim(value, F.lit(IP_TAIL))


def without_leading_zeros(value: Column) -> Column:
    """Octets without leading zeros; ``0`` stays."""
    return F.regexp_replace(value, r"(^|\.)0+(?=\d)", "$1")


def ipv4_ok(value: Column) -> Column:
    octets = F.split(without_leading_zeros(value), r"\.", -1)
    return F.coalesce((F.size(octets) == 4) & F.forall(octets, lambda o: o.rlike(r"^\d{1,3}$") & (o.try_cast("int") <= 255)), F.lit(False))


def ipv4_reserved(value: Column) -> Column:
    """Private, local, shared, documentation, benchmark, multicast and future addresses."""
    clean = without_leading_zeros(strip_ip_tail(value))
    octets = F.split(clean, r"\.", -1)
    first, second = F.get(octets, 0).try_cast("int"), F.get(octets, 1).try_cast("int")
    prefixed = F.lit(False)
    for p in RESERVED_V4:
        prefixed = prefixed | clean.startswith(p)
    shared = ((first == 100) & second.between(64, 127)) | (first >= 224)
    return F.coalesce(ipv4_ok(clean) & (prefixed | shared), F.lit(False))


def ipv6_reserved(value: Column) -> Column:
    """By prefix; the caller has checked that the value is an address."""
    clean = F.lower(strip_ip_tail(value))
    found = F.lit(False)
    for p in RESERVED_V6:
        found = found | clean.startswith(p)
    return F.coalesce(found, F.lit(False))
