"""Unsigned 64-bit words held as the raw bits of a Spark LONG.

Spark has no unsigned long. A word w of 0 .. 2**64-1 is stored as w when
w < 2**63, else as w - 2**64. Every comparison, sort and maximum goes through
these helpers; equality, grouping and hashing need none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_63 = 1 << 63
TWO_64 = 1 << 64
#: Highest word, 2**64 - 1.
MAX_WORD = TWO_64 - 1


def to_signed(word: int) -> int:
    """The LONG that holds a word; raises ValueError outside 0 .. 2**64-1."""
    if not 0 <= word < TWO_64:
        raise ValueError(f"not an unsigned 64-bit word: {word}")
    return word - TWO_64 if word >= TWO_63 else word


def to_unsigned(value: int) -> int:
    """The word that a LONG holds."""
    return value + TWO_64 if value < 0 else value


def word(value: int) -> Column:
    """Literal of a word."""
    return F.lit(to_signed(value)).cast("long")


def order_key(c: Column) -> Column:
    """LONG whose signed order is the unsigned order of c; its own inverse."""
    return c.bitwiseXOR(F.lit(-TWO_63))


def between(c: Column, low: int, high: int) -> Column:
    """low <= c <= high on words, as plain comparisons that reach a Parquet scan."""
    if low > high:
        return F.lit(False)
    lo, hi = F.lit(to_signed(low)), F.lit(to_signed(high))
    if low < TWO_63 <= high:
        return (c >= lo) | (c <= hi)
    return (c >= lo) & (c <= hi)


def is_extended(address: Column) -> Column:
    """Bit 0 of an address tells extended points from simple ones."""
    return address.bitwiseAND(F.lit(1)) == 1


def set_bit0(address: Column) -> Column:
    return address.bitwiseOR(F.lit(1))


def place_bucket(address: Column, n: Column | int) -> Column:
    """(address with bit 0 cleared) mod n on words, for 1 <= n < 2**62, without overflow."""
    n = F.lit(n).cast("long") if isinstance(n, int) else n
    return (F.lit(2) * (F.shiftrightunsigned(address, 1) % n)) % n
