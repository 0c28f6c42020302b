"""Button masks: unsigned 32-bit values in longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 0xFFFFFFFF


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def u32(c: Column | str) -> Column:
    return _col(c).cast("long").bitwiseAND(F.lit(U32))


def pressed(before: Column | str, after: Column | str) -> Column:
    """Bits that are set now and weren't before."""
    return u32(after).bitwiseAND(F.bitwise_not(u32(before)))


def released(before: Column | str, after: Column | str) -> Column:
    return pressed(after, before)


def popcount(c: Column | str) -> Column:
    return F.bit_count(u32(c)).cast("long")


def unpacked(c: Column | str, bits: int = 32) -> Column:
    """0 and 1 for each bit, lowest first."""
    c = u32(c)
    return F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: F.call_function("shiftright", c, b).bitwiseAND(F.lit(1)).cast("int"))


def names(c: Column | str, table: dict[int, str]) -> Column:
    """Names of the set bits, in order of the bit; ``table`` is mask to name."""
    found = [F.when(u32(c).bitwiseAND(F.lit(m)) != 0, F.lit(n)) for m, n in sorted(table.items())]
    return F.array_compact(F.array(*found))


def zigzag(c: Column | str) -> Column:
    """Signed to unsigned, small magnitudes first."""
    c = _col(c).cast("long")
    return F.shiftleft(c, 1).bitwiseXOR(F.shiftright(c, 63))


def unzigzag(c: Column | str) -> Column:
    c = _col(c).cast("long")
    return F.shiftrightunsigned(c, 1).bitwiseXOR(-c.bitwiseAND(F.lit(1)))


def varint(c: Column | str) -> Column:
    """The bytes of an unsigned value, seven bits each, lowest first, with a mark on all but the last."""
    c = _col(c).cast("long")
    n = F.greatest(F.lit(1), F.ceil((F.lit(64) - F.length(F.regexp_extract(F.lpad(F.bin(c), 64, "0"), "^0*", 0))) / F.lit(7.0))).cast("int")
    part = lambda k: F.call_function("shiftrightunsigned", c, k * 7).bitwiseAND(F.lit(127))
    hexed = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.lpad(F.hex(F.when(k + 1 < n, part(k) + 128).otherwise(part(k))), 2, "0"))
    return F.unhex(F.array_join(hexed, ""))


def unvarint(c: Column | str) -> Column:
    """The value of one varint."""
    c = _col(c)
    return F.aggregate(
        F.sequence(F.lit(0), F.octet_length(c) - 1),
        F.lit(0).cast("long"),
        lambda a, k: a.bitwiseOR(F.call_function("shiftleft", F.conv(F.hex(F.call_function("substring", c, k + 1, F.lit(1))), 16, 10).cast("long").bitwiseAND(F.lit(127)), k * 7)),
    )
