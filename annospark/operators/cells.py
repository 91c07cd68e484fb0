"""Geometry to grid cells: candidate cells of the bounding box by generators, then an exact overlap test.

Rules where floating point and degenerate shapes matter: indices are clamped
to the grid, an object on a cell boundary has at least one cell, and an axis
without extent is one cell.  ``compat=True`` gives lines and polylines the
overlap test that orders end points on each axis by itself (anti-diagonal
segments then count as diagonal ones); the default test is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annospark.functions import morton
from annospark.operators.bounds import extent
from annospark.plans.model import CoordSpace, Grid, geometry_columns


def _by_level(values: Sequence, level: Column, kind: str) -> Column:
    return F.element_at(F.lit(list(values)).cast(f"array<{kind}>"), level + 1)


def _span(lo: Column, hi: Column, origin: float, size: Column, cells: Column, point: bool) -> tuple[Column, Column]:
    """First and last cell of an interval."""
    some = size > 0
    top = cells - 1
    first = F.when(some, F.floor((lo - origin) / F.when(some, size))).otherwise(F.lit(0).cast("long"))
    first = F.greatest(F.least(first, top), F.lit(0).cast("long"))
    if point:
        return first, first
    last = F.when(some, F.ceil((hi - origin) / F.when(some, size)) - 1).otherwise(F.lit(0).cast("long"))
    return first, F.greatest(F.least(last, top), first)


def _overlap_ellipsoid(axes) -> Column:
    """Sum over axes of (distance of the cell / radius) squared is at most 1; a zero radius must lie in the cell's interval."""
    total, inside = F.lit(0.0), F.lit(True)
    for lo, hi, (c, r) in axes:
        gap = F.greatest(lo - c, c - hi, F.lit(0.0))
        total = total + F.when(r > 0, F.pow(gap / F.when(r > 0, r), F.lit(2.0))).otherwise(F.lit(0.0))
        inside = inside & ((r > 0) | (gap <= 0))
    return inside & (total <= 1.0)


def _overlap_segment(axes, compat: bool) -> Column:
    """The part of the segment inside the cell, as an interval of its parameter, is not empty."""
    first, last, inside = F.lit(0.0), F.lit(1.0), F.lit(True)
    for lo, hi, (a, b) in axes:
        if compat:
            a, b = F.least(a, b), F.greatest(a, b)
        d = b - a
        moves = d != 0
        s, t = (lo - a) / F.when(moves, d), (hi - a) / F.when(moves, d)
        first = F.greatest(first, F.least(s, t))  # nulls (no movement) are skipped
        last = F.least(last, F.greatest(s, t))
        inside = inside & (moves | ((a >= lo) & (a <= hi)))
    return inside & (first <= last)


def assign_cells(df: DataFrame, space: CoordSpace, kind: str, grids: Sequence[Grid], lower: Sequence[float], level: str = "level", compat: bool = False) -> DataFrame:
    """A row for each cell that an annotation touches at its level: the row's columns, ``cell_<axis>`` and ``code``."""
    own, at = df.columns, F.col(level)
    sizes = [_by_level([g.chunk[d] for g in grids], at, "double") for d in range(len(space.names))]
    counts = [_by_level([g.shape[d] for g in grids], at, "bigint") for d in range(len(space.names))]
    out = df
    for d, (n, (lo, hi)) in enumerate(zip(space.names, extent(space, kind))):
        first, last = _span(lo, hi, float(lower[d]), sizes[d], counts[d], kind == "point")
        out = out.withColumn(f"cell_{n}", first) if kind == "point" else out.withColumn(f"__f_{n}", first).withColumn(f"__l_{n}", last)
    if kind != "point":
        for n in space.names:
            out = out.withColumn(f"cell_{n}", F.explode(F.sequence(f"__f_{n}", f"__l_{n}")))
        cells = []
        for d, n in enumerate(space.names):
            lo = F.lit(float(lower[d])) + F.col(f"cell_{n}") * sizes[d]
            cells.append((lo, lo + sizes[d]))
        groups = geometry_columns(space, kind)
        if kind == "ellipsoid" or kind == "line":
            axes = [(lo, hi, tuple(F.col(g[d]).cast("double") for g in groups)) for d, (lo, hi) in enumerate(cells)]
            out = out.where(_overlap_ellipsoid(axes) if kind == "ellipsoid" else _overlap_segment(axes, compat))
        elif kind == "polyline":
            v = F.col("vertices")
            pairs = F.arrays_zip(F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))).alias("a"), F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))).alias("b"))
            touches = F.exists(pairs, lambda s: _overlap_segment([(lo, hi, (s["a"][n].cast("double"), s["b"][n].cast("double"))) for n, (lo, hi) in zip(space.names, cells)], compat))
            out = out.where((F.size(v) == 1) | touches)
    code = None
    for i, g in enumerate(grids):
        c = morton.encode([F.col(f"cell_{n}") for n in space.names], g.shape)
        code = F.when(at == i, c) if code is None else code.when(at == i, c)
    return out.select(*own, *[F.col(f"cell_{n}").cast("int").alias(f"cell_{n}") for n in space.names], code.alias("code"))


def collect_vertices(vertices: DataFrame, space: CoordSpace, id_col: str = "annotation_id", order_col: str = "vertex") -> DataFrame:
    """Vertices of each polyline as an array of structs, in order of ``order_col``."""
    v = F.struct(F.col(order_col).alias("__o"), *[F.col(n).cast("double").alias(n) for n in space.names])
    grouped = vertices.groupBy(id_col).agg(F.array_sort(F.collect_list(v)).alias("__v"))
    return grouped.select(id_col, F.transform("__v", lambda x: F.struct(*[x[n].alias(n) for n in space.names])).alias("vertices"))


def with_vertices(main: DataFrame | None, vertices: DataFrame, space: CoordSpace, id_col: str = "annotation_id", order_col: str = "vertex") -> DataFrame:
    """Polylines with their vertices; those without any, and vertices without a polyline, are dropped. No main table: the vertices' ids."""
    grouped = collect_vertices(vertices, space, id_col, order_col)
    return grouped if main is None else main.join(grouped, id_col)


def dropped_polylines(main: DataFrame, vertices: DataFrame, id_col: str = "annotation_id") -> DataFrame:
    """One row: ``polylines`` of ``main`` without a vertex, ``vertex_groups`` without a polyline; ids alone are compared."""
    ids = main.select(id_col).distinct().withColumn("__m", F.lit(True)).join(vertices.select(id_col).distinct().withColumn("__v", F.lit(True)), id_col, "full")
    return ids.agg(F.count_if(F.col("__v").isNull()).alias("polylines"), F.count_if(F.col("__m").isNull()).alias("vertex_groups"))


def chunk_limits(assigned: DataFrame, level: str = "level") -> DataFrame:
    """The most annotations in a cell of each level: ``level, chunks, limit``."""
    per = assigned.groupBy(level, "code").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(level).agg(F.count(F.lit(1)).alias("chunks"), F.max("n").alias("limit"))
