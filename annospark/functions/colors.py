"""Deterministic colours of segment ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annospark.functions.bits import MASK32, Stages, mul32, rotl32

# Fixed values of the viewer's colour hash.
K1, K2, STEP = 0xCC9E2D51, 0x1B873593, 0xE6546B64


def _combine(s: Stages, state: Column, value: Column) -> Column:
    v = s.let(mul32(s.let(value.bitwiseAND(F.lit(MASK32))), K1))
    v = s.let(mul32(s.let(rotl32(v, 15)), K2))
    x = s.let(rotl32(s.let(state.bitwiseXOR(v)), 13))
    return s.let((x * 5 + F.lit(STEP)).bitwiseAND(F.lit(MASK32)))


def with_color(df: DataFrame, segment: Column, out: str = "color", seed: int | Column = 0) -> DataFrame:
    """``df`` with ``#rrggbb`` of each segment id (a long's bits); null for null ids."""
    s = Stages(df)
    state = (seed if isinstance(seed, Column) else F.lit(seed)).cast("long").bitwiseAND(F.lit(MASK32))
    id_ = s.let(segment.cast("long"))
    h = _combine(s, _combine(s, state, id_), F.shiftright(id_, 32))
    hue = s.let(h.bitwiseAND(F.lit(255)) / F.lit(255.0) * 6)
    sat = s.let(F.lit(0.5) + F.lit(0.5) * (F.shiftright(h, 8).bitwiseAND(F.lit(255)) / F.lit(255.0)))
    sector = s.let(F.floor(hue))
    rest = s.let(hue - sector)
    low, fall, rise = s.let(1 - sat), s.let(1 - sat * rest), s.let(1 - sat * (1 - rest))
    one = F.lit(1.0)
    order = [(one, rise, low), (fall, one, low), (low, one, rise), (low, fall, one), (rise, low, one), (one, low, fall)]
    at = sector % 6

    def channel(k: int) -> Column:
        c = F.when(at == 0, order[0][k])
        for i in range(1, 6):
            c = c.when(at == i, order[i][k])
        return F.lpad(F.lower(F.hex(F.bround(c * 255, 0).cast("long"))), 2, "0")

    return s.done(**{out: F.concat(F.lit("#"), channel(0), channel(1), channel(2))})


def unpack(color: Column) -> list[Column]:
    """Red, green and blue of ``#rrggbb``."""
    return [F.conv(F.substring(color, 2 + 2 * k, 2), 16, 10).cast("int") for k in range(3)]


def packed(color: Column) -> Column:
    """``#rrggbb`` as one integer."""
    return F.conv(F.substring(color, 2, 6), 16, 10).cast("long")


def color_shader(seed: int = 0, size: float = 10.0) -> str:
    """A point shader that colours 32-bit segment ids, from a control, as :func:`with_color` does."""
    return f"""#uicontrol int seed slider(min=0, max=4294967295, default={seed});
#uicontrol int segment slider(min=0, max=4294967295, default=1);
uint stirred(uint state, uint word) {{
  word *= {K1:#x}u;
  word = (word << 15 | word >> 17) * {K2:#x}u;
  state ^= word;
  return (state << 13 | state >> 19) * 5u + {STEP:#x}u;
}}
void main() {{
  uint h = stirred(stirred(uint(seed), uint(segment)), 0u);
  float hue = 6.0 * float(h & 255u) / 255.0;
  float saturation = 0.5 + 0.5 * float(h >> 8 & 255u) / 255.0;
  vec3 pure = clamp(abs(mod(hue + vec3(0.0, 4.0, 2.0), 6.0) - 3.0) - 1.0, 0.0, 1.0);
  setPointMarkerSize({size});
  setColor(vec4(mix(vec3(1.0), pure, saturation), 1.0));
}}
"""
