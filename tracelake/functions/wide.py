"""Unsigned 64-bit arithmetic on longs, modulo 2**64: no step overflows, so it is the same in every mode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scan import let

_LIMB, _MASK = 16, 0xFFFF


def _limbs(c: int) -> list[int]:
    return [c >> (_LIMB * k) & _MASK for k in range(4)]


def signed(c: int) -> int:
    """The long with the bits of an unsigned number."""
    c &= (1 << 64) - 1
    return c - (1 << 64) if c >> 63 else c


def _joined(limbs: list[Column]) -> Column:
    """Limbs, each with what it carries to the next, as one long."""
    out, carry = F.lit(0).cast("long"), F.lit(0).cast("long")
    for k, limb in enumerate(limbs):
        whole = limb + carry
        out = out.bitwiseOR(F.shiftleft(whole.bitwiseAND(_MASK), _LIMB * k))
        carry = F.shiftrightunsigned(whole, _LIMB)
    return out


def _split(x: Column, f: Callable[[list[Column]], list[Column]]) -> Column:
    parts = F.array(*[F.shiftrightunsigned(x, _LIMB * k).bitwiseAND(_MASK) for k in range(4)])
    return let(parts, lambda p: _joined(f([p[k] for k in range(4)])))


def add(x: Column, c: int) -> Column:
    return _split(x, lambda p: [p[k] + F.lit(v).cast("long") for k, v in enumerate(_limbs(c))])


def multiply(x: Column, c: int) -> Column:
    b = _limbs(c)

    def column(p: list[Column], k: int) -> Column:
        out = p[0] * F.lit(b[k]).cast("long")
        for i in range(1, k + 1):
            out = out + p[i] * F.lit(b[k - i]).cast("long")
        return out

    return _split(x, lambda p: [column(p, k) for k in range(4)])


def rotated(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def splitmix(x: Column) -> Column:
    """The splitmix64 digest of a long read as unsigned."""
    first = let(add(x, 0x9E3779B97F4A7C15), lambda a: multiply(a.bitwiseXOR(F.shiftrightunsigned(a, 30)), 0xBF58476D1CE4E5B9))
    second = let(first, lambda a: multiply(a.bitwiseXOR(F.shiftrightunsigned(a, 27)), 0x94D049BB133111EB))
    return let(second, lambda a: a.bitwiseXOR(F.shiftrightunsigned(a, 31)))


def as_bits(x: Column) -> Column:
    """A number from 0 to 2**64 - 1 (a decimal where it passes a long) as the long with its bits."""
    wide, number = x.cast("decimal(20,0)"), lambda v: F.lit(str(v)).cast("decimal(20,0)")
    return F.when(wide >= number(1 << 63), wide - number(1 << 64)).otherwise(wide).cast("long")
