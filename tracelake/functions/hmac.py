"""HMAC-SHA256 as a column expression; the key's pads are prepared on the driver."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Lower-case hexadecimal HMAC of a string column's UTF-8 bytes."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def value_hash(value: Column, key: bytes | None = None) -> Column:
    """Sixteen hexadecimal digits that stand for a value; keyed if there is a key."""
    return F.substring(hmac_sha256(key, value) if key else F.sha2(value, 256), 1, 16)
