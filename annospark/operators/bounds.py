"""Validation and bounds of an annotation table in one aggregate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annospark.functions.bits import unsigned, unsigned_order
from annospark.plans.model import CoordSpace, geometry_columns

#: Ids that one task counts, about.
MOST_COUNTED = 400_000


@dataclass(frozen=True)
class Summary:
    count: int
    lower: tuple[float, ...]
    upper: tuple[float, ...]
    invalid: int
    max_id: int


def extent(space: CoordSpace, kind: str) -> list[tuple[Column, Column]]:
    """Smallest and largest coordinate of a row on each axis; for polylines those of ``vertices``."""
    out = []
    for k, n in enumerate(space.names):
        if kind == "polyline":
            values = F.transform("vertices", lambda v: v[n])
            out.append((F.array_min(values), F.array_max(values)))
            continue
        cols = [F.col(g[k]).cast("double") for g in geometry_columns(space, kind)]
        if kind == "point":
            out.append((cols[0], cols[0]))
        elif kind == "ellipsoid":
            out.append((cols[0] - cols[1], cols[0] + cols[1]))
        else:
            out.append((F.least(*cols), F.greatest(*cols)))
    return out


def is_invalid(space: CoordSpace, kind: str) -> Column:
    """A coordinate is null or NaN, or a polyline has no vertex."""
    if kind == "polyline":
        bad = lambda v: F.array_max(F.array(*[v[n].isNull() | F.isnan(v[n]) for n in space.names]))
        return F.col("vertices").isNull() | (F.size("vertices") == 0) | F.exists("vertices", bad)
    out = F.lit(False)
    for c in (c for g in geometry_columns(space, kind) for c in g):
        out = out | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    return out


def bounds_frame(df: DataFrame, space: CoordSpace, kind: str) -> DataFrame:
    """One row: count, invalid, and lower_<axis>, upper_<axis>."""
    at = extent(space, kind)
    return df.agg(
        F.count(F.lit(1)).alias("count"), F.count_if(is_invalid(space, kind)).alias("invalid"),
        *[F.min(lo).alias(f"lower_{n}") for n, (lo, _) in zip(space.names, at)], *[F.max(hi).alias(f"upper_{n}") for n, (_, hi) in zip(space.names, at)],
    )


def repeated_ids(df: DataFrame, id_col: str, count: int) -> DataFrame:
    """Ids of more than one of ``count`` rows.

    Ids are dealt before they are counted: counts ahead of the shuffle would
    find nothing to join, and hold all ids that a task reads.
    """
    return df.select(id_col).repartition(max(1, -(-count // MOST_COUNTED)), id_col).groupBy(id_col).count().where(F.col("count") > 1)


def summarize(df: DataFrame, space: CoordSpace, kind: str, id_col: str = "annotation_id") -> Summary:
    """Bounds, count and largest id (unsigned); ValueError for an empty table, null or NaN coordinates, null or repeated ids."""
    at = extent(space, kind)
    r = df.agg(
        F.count(F.lit(1)), F.count_if(is_invalid(space, kind)), F.count_if(F.col(id_col).isNull()), F.max(unsigned_order(F.col(id_col))),
        *[F.min(lo) for lo, _ in at], *[F.max(hi) for _, hi in at],
    ).first()
    n, invalid, no_id, top = r[:4]
    if not n:
        raise ValueError("the annotation table is empty")
    if invalid or no_id:
        raise ValueError(f"{invalid} annotations have null or NaN coordinates and {no_id} no id")
    if repeated_ids(df, id_col, n).agg(F.count(F.lit(1))).first()[0]:
        raise ValueError("annotation ids are not unique")
    d = len(space.names)
    return Summary(n, tuple(map(float, r[4 : 4 + d])), tuple(map(float, r[4 + d :])), invalid, unsigned(top ^ -(1 << 63)))
