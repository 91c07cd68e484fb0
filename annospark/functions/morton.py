"""Compressed Morton codes of grid cells: bits of the axes in turn, first axis first, an axis only while it has bits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_places(shape: Sequence[int]) -> list[list[int]]:
    """For each axis (x first) where each of its bits goes in the code."""
    bits = [max(0, int(n) - 1).bit_length() for n in shape]
    places: list[list[int]] = [[] for _ in bits]
    at = 0
    for i in range(max(bits, default=0)):
        for axis, n in enumerate(bits):
            if i < n:
                places[axis].append(at)
                at += 1
    if at > 63:
        raise ValueError(f"a grid of shape {tuple(shape)} needs {at} bits")
    return places


def encode(cell: Sequence[Column], shape: Sequence[int]) -> Column:
    """The code of a cell (columns, x first) in a grid; coordinates must be in the grid."""
    terms = [F.shiftleft(F.shiftright(c.cast("long"), i).bitwiseAND(F.lit(1)), at) for c, places in zip(cell, bit_places(shape)) for i, at in enumerate(places)]
    code = F.lit(0).cast("long")
    for t in terms:
        code = code.bitwiseOR(t)
    return code


def decode(code: Column, shape: Sequence[int]) -> list[Column]:
    out = []
    for places in bit_places(shape):
        c = F.lit(0).cast("long")
        for i, at in enumerate(places):
            c = c.bitwiseOR(F.shiftleft(F.shiftrightunsigned(code, at).bitwiseAND(F.lit(1)), i))
        out.append(c)
    return out


def encode_int(cell: Sequence[int], shape: Sequence[int]) -> int:
    if any(not 0 <= c < n for c, n in zip(cell, shape)):
        raise ValueError(f"cell {tuple(cell)} is outside a grid of shape {tuple(shape)}")
    return sum((c >> i & 1) << at for c, places in zip(cell, bit_places(shape)) for i, at in enumerate(places))


def decode_int(code: int, shape: Sequence[int]) -> tuple[int, ...]:
    return tuple(sum((code >> at & 1) << i for i, at in enumerate(places)) for places in bit_places(shape))
