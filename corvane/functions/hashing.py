"""Hashes that decide scores, slices and partitions, as columns: 32-bit MurmurHash3, 64-bit mixing, encoded ids.

Numbers of 32 bits are held in longs, so that products never leave 64 bits: overflow is an error under ANSI rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF
# Fixed values of the published hash functions.
_C1, _C2, _ADD = 0xCC9E2D51, 0x1B873593, 0xE6546B64
_F1, _F2 = 0x85EBCA6B, 0xC2B2AE35
_M1, _M2 = 0x4CD6944C5CC20B6D, 0xFC12C5B19D3259E9


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _folded(x: Column, by: int) -> Column:
    """The bits of ``x``, and its higher ones over its lower ones."""
    return _let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, by)))


def _low(x: Column, c: int) -> Column:
    """The low 32 bits of a product of 32-bit numbers."""
    return _let(x, lambda v: (v.bitwiseAND(0xFFFF) * F.lit(c) + F.shiftleft((F.shiftrightunsigned(v, 16) * F.lit(c)).bitwiseAND(0xFFFF), 16)).bitwiseAND(_MASK))


def _rotated(x: Column, by: int) -> Column:
    return _let(x, lambda v: F.shiftleft(v, by).bitwiseOR(F.shiftrightunsigned(v, 32 - by)).bitwiseAND(_MASK))


def _stirred(k: Column) -> Column:
    return _low(_rotated(_low(k, _C1), 15), _C2)


def murmur3(data: Column, seed: int) -> Column:
    """The signed 32-bit MurmurHash3 (x86) of binary ``data``, as a long; null for null."""

    def block(digits: Column, i: Column) -> Column:
        """The number that up to four bytes from byte 4i make, the first lowest."""
        return F.conv(F.concat(*[F.substr(digits, i * 8 + at, F.lit(2)) for at in (7, 5, 3, 1)]), 16, 10).cast("long")

    def over(digits: Column) -> Column:
        n = F.floor(F.length(digits) / 2).cast("int")
        whole = F.floor(n / 4).cast("int")
        blocks = F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(F.array().cast("array<int>"))
        body = F.aggregate(blocks, F.lit(seed & _MASK).cast("long"), lambda h, i: (_low(_rotated(h.bitwiseXOR(_stirred(block(digits, i))), 13), 5) + F.lit(_ADD)).bitwiseAND(_MASK))
        tail = F.when(n % 4 > 0, _stirred(block(digits, whole))).otherwise(F.lit(0).cast("long"))
        h = body.bitwiseXOR(tail).bitwiseXOR(n.cast("long"))
        h = _low(_folded(_low(_folded(h, 16), _F1), 13), _F2)
        return _let(_folded(h, 16), lambda x: F.when(x > 0x7FFFFFFF, x - (1 << 32)).otherwise(x))

    return F.when(data.isNotNull(), _let(F.hex(data), over))


def mix64(x: Column) -> Column:
    """The bits of a long, mixed; null for null."""

    def times(u: Column, c: int) -> Column:
        """The low 64 bits of a product."""
        low, high = u.bitwiseAND(_MASK), F.shiftrightunsigned(u, 32)
        a, b = low.bitwiseAND(0xFFFF) * F.lit(c & _MASK), F.shiftrightunsigned(low, 16) * F.lit(c & _MASK)
        least = a + F.shiftleft(b.bitwiseAND(0xFFFF), 16)
        carried = F.shiftrightunsigned(least, 32) + F.shiftrightunsigned(b, 16)
        top = (carried + _low(low, c >> 32) + _low(high, c & _MASK)).bitwiseAND(_MASK)
        return F.shiftleft(top, 32).bitwiseOR(least.bitwiseAND(_MASK))

    once = _let(_folded(x, 32), lambda u: times(u, _M1))
    return _folded(_let(_folded(once, 29), lambda u: times(u, _M2)), 32)


def as_long(c: Column, kind: str) -> Column | None:
    """A whole number, a flag or a time in milliseconds as a long; none for other types."""
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.unix_millis(c.cast("timestamp"))
    return c.cast("int").cast("long") if kind == "boolean" else c.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else None


def mix32(key: int, salt: int) -> int:
    """Two 32-bit numbers of a request, mixed."""
    k = (key ^ salt) & _MASK
    for shift, c in ((16, _F1), (13, _F2)):
        k = (k ^ k >> shift) * c & _MASK
    return k ^ k >> 16


def string_hash(s: str) -> int:
    """The 32-bit polynomial hash (base 31) of a name's UTF-16 units."""
    h, units = 0, s.encode("utf-16-le")
    for i in range(0, len(units), 2):
        h = (31 * h + int.from_bytes(units[i : i + 2], "little")) & _MASK
    return h


def encoded_id(doc_id: Column) -> Column:
    """The bytes that an id is stored as: digits packed two to a byte, base64 decoded, any other text as it is, each under a first byte of its own."""
    text = doc_id.cast("string")
    digits = F.unhex(F.concat(F.lit("FE"), text, F.when(F.length(text) % 2 == 1, F.lit("F")).otherwise(F.lit(""))))
    based = F.regexp_like(text, F.lit("^(?:[A-Za-z0-9_-]{4})*(?:[A-Za-z0-9_-][AQgw]|[A-Za-z0-9_-]{2}[AEIMQUYcgkosw048])?$")) & (text != "")
    decoded = F.unbase64(F.rpad(F.translate(text, "-_", "+/"), F.ceil(F.length(text) / 4).cast("int") * 4, F.lit("=")))
    decoded = F.when(F.hex(F.substring(decoded, 1, 1)) >= "FD", F.concat(F.unhex(F.lit("FD")), decoded)).otherwise(decoded)
    return F.when(F.regexp_like(text, F.lit("^[0-9]+$")), digits).when(based, decoded).otherwise(F.concat(F.unhex(F.lit("FF")), F.encode(text, "UTF-8")))
