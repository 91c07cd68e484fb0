"""Unsigned integers in signed longs, and staged 32-bit arithmetic.

A uint64 is kept as the long with the same bits.  Arithmetic on 32-bit words
stays below 2**63, so it is safe with ANSI overflow checks.  Intermediate
values that are used more than once become columns of their own (a
:class:`Stages`), so plans stay linear in size and inside generated code.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF
_names = itertools.count()


def signed(value: int) -> int:
    """The long with the bits of an unsigned 64-bit integer."""
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def unsigned(value: int) -> int:
    return value & ((1 << 64) - 1)


def unsigned_order(c: Column) -> Column:
    """A long that sorts as the unsigned value of ``c`` does."""
    return c.bitwiseXOR(F.lit(-(1 << 63)))


def unsigned_text(c: Column) -> Column:
    """The unsigned value in decimal digits."""
    return F.conv(F.hex(c), 16, 10)


def from_decimal(c: Column) -> Column:
    """decimal(20,0), as Parquet's UINT_64 arrives, to a long with the same bits."""
    c = c.cast("decimal(20,0)")
    big = F.lit("9223372036854775808").cast("decimal(20,0)")
    return F.when(c >= big, c - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(c).cast("long")


def mul32(a: Column, c: int) -> Column:
    """Low 32 bits of a * c, for ``a`` a column of 32-bit words."""
    high = F.shiftleft((F.shiftrightunsigned(a, 16) * F.lit(c)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (a.bitwiseAND(F.lit(0xFFFF)) * F.lit(c) + high).bitwiseAND(F.lit(MASK32))


def rotl32(a: Column, n: int) -> Column:
    return F.shiftleft(a, n).bitwiseOR(F.shiftrightunsigned(a, 32 - n)).bitwiseAND(F.lit(MASK32))


class Stages:
    """Adds temporary columns to a DataFrame and drops them in the end."""

    def __init__(self, df: DataFrame):
        self.df, self.columns, self.own = df, df.columns, []

    def let(self, value: Column) -> Column:
        name = f"__t{next(_names)}"
        self.df = self.df.withColumn(name, value)
        self.own.append(name)
        return F.col(name)

    def done(self, **results: Column) -> DataFrame:
        return self.df.select(*self.columns, *[c.alias(n) for n, c in results.items()])
