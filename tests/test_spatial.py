"""Cells of hand-made geometry in a grid of 4 cells an axis over [0, 1]."""

import random

import pytest
from annospark.operators import bounds, levels
from annospark.operators.bounds import summarize
from annospark.operators.cells import assign_cells, collect_vertices, with_vertices
from annospark.operators.levels import shuffled_key, with_level
from annospark.plans.model import CoordSpace, Grid, geometry_columns, quotas, spatial_grids
from pyspark.sql import functions as F


def cells(spark, axes, kind, rows, compat=False, grid=None):
    space = CoordSpace.of(axes)
    cols = [c for g in geometry_columns(space, kind) for c in g]
    df = spark.createDataFrame([(i, 0, *map(float, r)) for i, r in enumerate(rows)], "annotation_id long, level int, " + ", ".join(f"{c} double" for c in cols))
    grid = grid or Grid((0.25,) * len(space.names), (4,) * len(space.names))
    out = {i: set() for i in range(len(rows))}
    for r in assign_cells(df, space, kind, [grid], [0.0] * len(space.names), compat=compat).collect():
        cell = tuple(r[f"cell_{a}"] for a in space.names)
        assert cell not in out[r.annotation_id]
        out[r.annotation_id].add(cell)
    return [out[i] for i in range(len(rows))]


def counts(*args, **kw):
    return [len(c) for c in cells(*args, **kw)]


def test_lines(spark):
    assert counts(spark, "xy", "line", [(0.1, 0.1, 0.2, 0.2), (0.1, 0.1, 0.6, 0.1), (0.1, 0.1, 0.9, 0.1)]) == [1, 3, 4]
    assert counts(spark, "xyz", "line", [(0.1, 0.1, 0.1, 0.2, 0.2, 0.2), (0.1, 0.1, 0.1, 0.6, 0.1, 0.1), (0.1, 0.1, 0.1, 0.9, 0.1, 0.1)]) == [1, 3, 4]


def test_antidiagonal(spark):
    row = [(0.1, 0.85, 0.8, 0.1)]
    assert cells(spark, "xy", "line", row) == [{(0, 2), (0, 3), (1, 1), (1, 2), (2, 0), (2, 1), (3, 0)}]
    assert cells(spark, "xy", "line", row, compat=True) == [{(0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (2, 3), (3, 3)}]


def test_points_boxes_ellipsoids(spark):
    assert counts(spark, "xy", "point", [(0.1, 0.1), (0.6, 0.5), (1.0, 1.0)]) == [1, 1, 1]
    assert counts(spark, "xy", "axis_aligned_bounding_box", [(0.05, 0.05, 0.2, 0.2), (0.05, 0.05, 0.3, 0.3)]) == [1, 4]
    assert counts(spark, "xyz", "axis_aligned_bounding_box", [(0.05, 0.05, 0.05, 0.2, 0.2, 0.2), (0.05, 0.05, 0.05, 0.3, 0.3, 0.2)]) == [1, 4]
    assert counts(spark, "xyz", "ellipsoid", [(0.125,) * 3 + (0.05,) * 3, (0.5,) * 3 + (0.3,) * 3, (0.125,) * 3 + (0.0,) * 3]) == [1, 32, 1]


def test_degenerate(spark):
    """On a boundary, at the upper bound of a rounded cell, and on an axis without extent."""
    assert counts(spark, "xy", "axis_aligned_bounding_box", [(0.25, 0.1, 0.25, 0.1), (0.3, 0.1, 0.3, 0.1)]) == [1, 1]
    import numpy as np

    one = Grid((float(np.float32(0.7)), 0.0), (1, 1))
    assert counts(spark, "xy", "axis_aligned_bounding_box", [(0.0, 0.0, 0.7, 0.0)], grid=one) == [1]


def test_polylines(spark):
    space = CoordSpace.of("xyz")
    lines = {1: [0.1, 0.12, 0.14], 2: [0.1, 0.4, 0.6, 0.9], 3: [0.1]}
    v = spark.createDataFrame([(i, k, x, 0.1, 0.1) for i, xs in lines.items() for k, x in enumerate(xs)], "annotation_id long, vertex int, x double, y double, z double")
    df = collect_vertices(v.orderBy(F.rand(1)), space).withColumn("level", F.lit(0))
    got = assign_cells(df, space, "polyline", [Grid((0.25,) * 3, (4,) * 3)], [0.0] * 3).groupBy("annotation_id").count().collect()
    assert {r[0]: r[1] for r in got} == {1: 1, 2: 4, 3: 1}
    main = spark.createDataFrame([(1,), (2,), (9,)], "annotation_id long")
    assert {r.annotation_id for r in with_vertices(main, v, space).collect()} == {1, 2}


def test_lines_against_dense_sampling(spark):
    r = random.Random(5)
    rows = [tuple(r.random() for _ in range(8)) for _ in range(25)]
    got = cells(spark, "xyzt", "line", rows)
    for row, c in zip(rows, got):
        sampled = {tuple(min(3, int((a + (b - a) * k / 2000) / 0.25)) for a, b in zip(row[:4], row[4:])) for k in range(2001)}
        assert sampled <= c
        assert len(c) <= len(sampled) + 3


def test_grids_and_quotas():
    cube = spatial_grids((0, 0, 0), (1, 1, 1), (1, 1, 1), 4)
    assert [g.shape for g in cube] == [(1,) * 3, (2,) * 3, (4,) * 3, (8,) * 3]
    assert quotas(1000, cube, 10) == [10, 80, 640, 270]
    flat = spatial_grids((0, 0, 0), (8, 4, 1), (1, 1, 1), 6)
    assert [g.shape for g in flat] == [(1, 1, 1), (2, 1, 1), (4, 2, 1), (8, 4, 1), (16, 8, 2), (32, 16, 4)]
    assert quotas(1000, flat, 10) == [10, 20, 80, 320, 570, 0]
    assert [g.shape for g in spatial_grids((0, 0, 0), (1, 10, 100), (100, 10, 1), 4)] == [g.shape for g in cube]
    assert quotas(7, cube[:1], 0) == [7]
    with pytest.raises(ValueError):
        quotas(7, cube, 0)
    with pytest.raises(ValueError):
        spatial_grids((0,), (1,), (1,), 65)


@pytest.mark.parametrize("sizes", [[10, 80, 640, 270], [1000], [0, 0, 1000], [1, 998, 1]])
def test_levels_are_exact(spark, sizes):
    df = spark.range(0, 2000, 2).select((F.col("id") - 500).alias("annotation_id"))  # some are large as unsigned
    for key in (shuffled_key(seed=4), F.lit(7)):
        got = {r.level: r["count"] for r in with_level(df, sizes, key).groupBy("level").count().collect()}
        assert got == {i: n for i, n in enumerate(sizes) if n}
    again = [sorted(map(tuple, with_level(df.repartition(k), sizes, shuffled_key(seed=4)).collect())) for k in (1, 5)]
    assert again[0] == again[1]


def test_summary(spark):
    space = CoordSpace.of("xy")
    df = spark.createDataFrame([(1, 0.0, 1.0), (-1, 2.0, -1.0)], "annotation_id long, x double, y double")
    s = summarize(df, space, "point")
    assert (s.count, s.lower, s.upper, s.max_id) == (2, (0.0, -1.0), (2.0, 1.0), (1 << 64) - 1)
    for bad in [(1, None, 1.0), (1, float("nan"), 1.0), (None, 1.0, 1.0)]:
        with pytest.raises(ValueError):
            summarize(df.unionByName(spark.createDataFrame([bad], df.schema)), space, "point")
    with pytest.raises(ValueError):
        summarize(df.unionByName(df), space, "point")
    with pytest.raises(ValueError):
        summarize(df.limit(0), space, "point")


def test_coordinate_spaces():
    assert CoordSpace.of("xyz").to_json() == {a: [1e-9, "m"] for a in "xyz"}
    assert CoordSpace.of({"names": ["x", "y"], "units": "um", "scales": [2, 3]}).scales == (2.0, 3.0)
    assert CoordSpace.of({"x": [8e-9, "m"]}).units == ("m",)
    for bad in ("xX", "xx", ["X"], 5, {"names": "xy", "colour": 1}):
        with pytest.raises(ValueError):
            CoordSpace.of(bad)


@pytest.mark.parametrize("most", [10, 100_000])
def test_levels_of_tied_keys(spark, monkeypatch, most):
    """Keys that most rows share are cut by the ids of their rows."""
    monkeypatch.setattr(levels, "MOST_RANKED", most)
    df = spark.range(3000).selectExpr("id * 7919 % 3001 annotation_id", "if(id % 10 = 0, id, if(id % 2 = 0, 5, 700)) k").withColumn("k", F.col("k").cast("long"))
    rows = sorted((r.k, r.annotation_id) for r in df.collect())
    sizes = [100, 0, 900, 1, 1999]
    want, at = {}, 0
    for level, n in enumerate(sizes):
        want |= {i: level for _, i in rows[at : at + n]}
        at += n
    got = levels.with_level(df, sizes, F.col("k"))
    assert {r.annotation_id: r.level for r in got.collect()} == want


def test_repeated_ids_are_dealt_before_they_are_counted(spark):
    """No task holds all ids that it reads: both steps of the count come after the shuffle, whose tasks grow with the rows."""
    df = spark.range(0, 1000, 1, 2).select((F.col("id") % 990).alias("annotation_id"))
    found = bounds.repeated_ids(df, "annotation_id", 5 * bounds.MOST_COUNTED)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.rindex("HashAggregate") < plan.index("Exchange")
    assert found.rdd.getNumPartitions() == 5 and sorted(r[0] for r in found.collect()) == list(range(10))
