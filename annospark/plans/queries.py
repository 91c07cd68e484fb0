"""Registered queries over the standard tables, each with its SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annospark.functions import morton
from annospark.functions.colors import with_color
from annospark.functions.shardhash import ShardSpec, with_low64, with_shard
from annospark.operators import local, segprops, select
from annospark.operators.bounds import bounds_frame, is_invalid, summarize
from annospark.operators.cells import assign_cells, chunk_limits, collect_vertices, with_vertices
from annospark.operators.encode import encode_records, group_frame
from annospark.operators.levels import shuffled_key, with_level
from annospark.operators.relationships import group_counts, pairs, restrict_to
from annospark.plans.export import export_annotations
from annospark.plans.model import CoordSpace, Grid, property_specs, quotas, spatial_grids
from annospark.sources.shards import read_sharded

XYZ, XY = CoordSpace.of("xyz"), CoordSpace.of("xy")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- views: the tables as geometry


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


_SECONDS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({0} as timestamp_ntz))"


def points(spark, d):
    return _t(spark, d, "events").select(F.col("event_id").alias("annotation_id"), F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"), (F.expr(_SECONDS.format("ts")) / F.lit(1e6)).alias("z"), "user_id", "event_type")


def boxes(spark, d):
    agg = [f(c).alias(n) for c, axis in (("l_quantity", "x"), ("l_extendedprice", "y"), (F.col("l_discount") + 0.0, "z")) for f, n in ((F.min, f"{axis}a"), (F.max, f"{axis}b"))]
    return _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("annotation_id")).agg(*agg)


def ellipsoids(spark, d):
    half = lambda c: (F.min(c), F.max(c))
    cols = []
    for c, a in (("l_quantity", "x"), ("l_extendedprice", "y"), (F.col("l_discount") + 0.0, "z")):
        lo, hi = half(c)
        cols += [((lo + hi) / 2).alias(a), ((hi - lo) / 2 + 1).alias(f"r{a}")]
    return _t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("annotation_id")).agg(*cols)


def lines(spark, d):
    day = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("double")
    ends = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(day("l_shipdate")).alias("xb"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("yb"))
    o = _t(spark, d, "orders").select("o_orderkey", day("o_orderdate").alias("xa"), F.col("o_totalprice").alias("ya"))
    return o.join(ends, o.o_orderkey == ends.l_orderkey).select(F.col("o_orderkey").alias("annotation_id"), "xa", "ya", "xb", "yb")


def vertices(spark, d):
    """A polyline for each user and event type, through the events in order of their ids."""
    return _t(spark, d, "events").select((F.col("user_id") * 8 + F.length("event_type") % 8).alias("annotation_id"), F.col("event_id").alias("vertex"), F.col("value").alias("x"), (F.col("event_id") % 1000).cast("double").alias("y"))


def segments(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("segment"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), (F.col("p_size") > 25).alias("is large"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


_PTS = "pts AS (SELECT event_id AS annotation_id, user_id::DOUBLE AS x, value AS y, epoch_us(ts::TIMESTAMP) / 1e6::DOUBLE AS z, user_id, event_type FROM events)"
_BOX = "box AS (SELECT l_orderkey AS annotation_id, min(l_quantity) AS xa, max(l_quantity) AS xb, min(l_extendedprice) AS ya, max(l_extendedprice) AS yb, min(l_discount + 0.0) AS za, max(l_discount + 0.0) AS zb FROM lineitem GROUP BY 1)"
_ELL = "ell AS (SELECT l_partkey AS annotation_id, " + ", ".join(f"(min({c}) + max({c})) / 2 AS {a}, (max({c}) - min({c})) / 2 + 1 AS r{a}" for c, a in (("l_quantity", "x"), ("l_extendedprice", "y"), ("(l_discount + 0.0)", "z"))) + " FROM lineitem GROUP BY 1)"
_LIN = "ends AS (SELECT l_orderkey, max(date_diff('day', DATE '1970-01-01', l_shipdate::DATE))::DOUBLE AS xb, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS yb FROM lineitem GROUP BY 1), lin AS (SELECT o_orderkey AS annotation_id, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE AS xa, o_totalprice AS ya, xb, yb FROM orders JOIN ends ON o_orderkey = l_orderkey)"
_VER = "ver AS (SELECT user_id * 8 + length(event_type) % 8 AS annotation_id, event_id AS vertex, value AS x, (event_id % 1000)::DOUBLE AS y FROM events)"

# ---- bounds and validation


def _bounds_sql(view, name, axes, lo, hi):
    return f"WITH {view} SELECT count(*) AS count, 0::BIGINT AS invalid, " + ", ".join([f"min({lo(a)}) AS lower_{a}, max({hi(a)}) AS upper_{a}" for a in axes]) + f" FROM {name}"


@query(_bounds_sql(_PTS, "pts", "xyz", lambda a: a, lambda a: a))
def bounds_point(spark, d):
    return bounds_frame(points(spark, d), XYZ, "point")


@query(_bounds_sql(_BOX, "box", "xyz", lambda a: f"least({a}a, {a}b)", lambda a: f"greatest({a}a, {a}b)"))
def bounds_box(spark, d):
    return bounds_frame(boxes(spark, d), XYZ, "axis_aligned_bounding_box")


@query(_bounds_sql(_LIN, "lin", "xy", lambda a: f"least({a}a, {a}b)", lambda a: f"greatest({a}a, {a}b)"))
def bounds_line(spark, d):
    return bounds_frame(lines(spark, d), XY, "line")


@query(_bounds_sql(_ELL, "ell", "xyz", lambda a: f"{a} - r{a}", lambda a: f"{a} + r{a}"))
def bounds_ellipsoid(spark, d):
    return bounds_frame(ellipsoids(spark, d), XYZ, "ellipsoid")


@query(f"WITH {_VER} SELECT count(DISTINCT annotation_id) AS count, 0::BIGINT AS invalid, min(x) AS lower_x, max(x) AS upper_x, min(y) AS lower_y, max(y) AS upper_y FROM ver")
def bounds_polyline(spark, d):
    return bounds_frame(collect_vertices(vertices(spark, d), XY), XY, "polyline")


@query("SELECT count(*) FILTER (WHERE x IS NULL OR y IS NULL OR isnan(x)) AS invalid, count(*) AS count FROM (SELECT CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'NaN'::DOUBLE ELSE value END AS x, user_id::DOUBLE AS y FROM events)")
def nan_null_audit(spark, d):
    df = _t(spark, d, "events").select(F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 11 == 0, float("nan")).otherwise(F.col("value")).alias("x"), F.col("user_id").cast("double").alias("y"))
    return df.agg(F.count_if(is_invalid(XY, "point")).alias("invalid"), F.count(F.lit(1)).alias("count"))


# ---- grids, quotas, levels

LEVELS, TARGET = 6, 100


def _halved(a, others):
    """SQL of an axis's width and shape at the next level; ties go to the first axis."""
    before = [o for o in others if o < a]
    widest = " AND ".join([f"w{a} > w{o}" if o in before else f"w{a} >= w{o}" for o in others])
    most = f"greatest({', '.join(f'w{o}' for o in sorted([a, *others]))})"
    split = f"(({widest}) OR w{a} / ({most} / 2) > 1.5)"
    return f"CASE WHEN {split} THEN w{a} / 2 ELSE w{a} END", f"CASE WHEN {split} THEN g{a} * 2 ELSE g{a} END"


_STEP = {a: _halved(a, [o for o in "xyz" if o != a]) for a in "xyz"}
_GRID = (
    f"{_PTS}, b AS (SELECT count(*) AS n, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM pts), "
    "g AS (SELECT 0 AS level, hx - lx AS wx, hy - ly AS wy, hz - lz AS wz, 1::BIGINT AS gx, 1::BIGINT AS gy, 1::BIGINT AS gz FROM b "
    f"UNION ALL SELECT level + 1, {', '.join(_STEP[a][0] for a in 'xyz')}, {', '.join(_STEP[a][1] for a in 'xyz')} FROM g WHERE level < {LEVELS - 1})"
)


def _grids(spark, d):
    df = points(spark, d)
    r = bounds_frame(df, XYZ, "point").first()
    return df, r, spatial_grids([r.lower_x, r.lower_y, r.lower_z], [r.upper_x, r.upper_y, r.upper_z], XYZ.scales, LEVELS)


@query(f"WITH RECURSIVE {_GRID} SELECT level, wx::FLOAT::DOUBLE AS chunk_x, wy::FLOAT::DOUBLE AS chunk_y, wz::FLOAT::DOUBLE AS chunk_z, gx AS grid_x, gy AS grid_y, gz AS grid_z FROM g")
def grid_levels(spark, d):
    *_, grids = _grids(spark, d)
    return spark.createDataFrame([(i, *g.chunk, *g.shape) for i, g in enumerate(grids)], "level int, chunk_x double, chunk_y double, chunk_z double, grid_x long, grid_y long, grid_z long")


_QUOTA = f"{_GRID}, q AS (SELECT level, gx * gy * gz * {TARGET} AS want FROM g), s AS (SELECT level, want, coalesce(sum(want) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q), quota AS (SELECT level, least(before, n) AS first, CASE WHEN level = {LEVELS - 1} THEN n ELSE least(before + want, n) END AS last FROM s, b)"


@query(f"WITH RECURSIVE {_QUOTA} SELECT level, (last - first)::BIGINT AS quota FROM quota")
def level_quota(spark, d):
    _, r, grids = _grids(spark, d)
    return spark.createDataFrame(list(enumerate(quotas(r["count"], grids, TARGET))), "level int, quota long")


@query(f"WITH RECURSIVE {_QUOTA}, r AS (SELECT annotation_id, row_number() OVER (ORDER BY annotation_id) - 1 AS rank FROM pts) SELECT annotation_id, level FROM r JOIN quota ON rank >= first AND rank < last")
def level_assign(spark, d):
    df, r, grids = _grids(spark, d)
    return with_level(df, quotas(r["count"], grids, TARGET), F.col("annotation_id")).select("annotation_id", "level")


@query(f"WITH RECURSIVE {_QUOTA} SELECT level, (last - first)::BIGINT AS n FROM quota WHERE last > first")
def level_sample(spark, d):
    """Sizes of a random assignment: the quotas exactly."""
    df, r, grids = _grids(spark, d)
    return with_level(df, quotas(r["count"], grids, TARGET), shuffled_key(seed=3)).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


# ---- cells of one 8 x 8 x 8 grid


def _one_grid(df, space, kind, cells=8):
    r = bounds_frame(df, space, kind).first()
    lower, upper = [r[f"lower_{a}"] for a in space.names], [r[f"upper_{a}"] for a in space.names]
    import numpy as np

    return [Grid(tuple(float(np.float32((b - a) / cells)) for a, b in zip(lower, upper)), (cells,) * len(lower))], lower


def _cells(df, space, kind):
    grids, lower = _one_grid(df, space, kind)
    return assign_cells(df.withColumn("level", F.lit(0)), space, kind, grids, lower).select("annotation_id", *[f"cell_{a}" for a in space.names])


def _span_sql(a, lo, hi):
    """Names f<a>, l<a> of the first and last cell of [lo, hi] on an axis."""
    first = f"greatest(least(floor(({lo} - l{a}) / c{a}), 7), 0)"
    return f"{first}::INT AS f{a}, greatest(least(ceil(({hi} - l{a}) / c{a}) - 1, 7), {first})::INT AS t{a}"


def _box_sql(view, name, axes, lo, hi, keep=""):
    b = ", ".join(f"min({lo(a)}) AS l{a}, ((max({hi(a)}) - min({lo(a)})) / 8)::FLOAT::DOUBLE AS c{a}" for a in axes)
    spans = ", ".join(_span_sql(a, lo(a), hi(a)) for a in axes)
    return (
        f"{view}, b AS (SELECT {b} FROM {name}), s AS (SELECT {name}.*, b.*, {spans} FROM {name}, b), "
        f"cand AS (SELECT *, {', '.join(f'l{a} + cell_{a} * c{a} AS lo_{a}, l{a} + cell_{a} * c{a} + c{a} AS hi_{a}' for a in axes)} FROM (SELECT * FROM s, {', '.join(f'LATERAL (SELECT unnest(generate_series(f{a}, t{a}))::INT AS cell_{a})' for a in axes)}))"
    )


@query(f"WITH {_PTS}, b AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, {', '.join(f'((max({a}) - min({a})) / 8)::FLOAT::DOUBLE AS c{a}' for a in 'xyz')} FROM pts) SELECT annotation_id, {', '.join(f'greatest(least(floor(({a} - l{a}) / c{a}), 7), 0)::INT AS cell_{a}' for a in 'xyz')} FROM pts, b")
def cells_point(spark, d):
    return _cells(points(spark, d), XYZ, "point")


@query(f"WITH {_box_sql(_BOX, 'box', 'xyz', lambda a: a + 'a', lambda a: a + 'b')} SELECT annotation_id, cell_x, cell_y, cell_z FROM cand")
def cells_box(spark, d):
    return _cells(boxes(spark, d), XYZ, "axis_aligned_bounding_box")


@query(f"WITH {_box_sql(_ELL, 'ell', 'xyz', lambda a: f'({a} - r{a})', lambda a: f'({a} + r{a})')} SELECT annotation_id, cell_x, cell_y, cell_z FROM cand WHERE 0.0 + {' + '.join(f'pow(greatest(lo_{a} - {a}, {a} - hi_{a}, 0.0) / r{a}, 2.0)' for a in 'xyz')} <= 1.0")
def cells_ellipsoid(spark, d):
    return _cells(ellipsoids(spark, d), XYZ, "ellipsoid")


def _slab_sql(ends):
    """ends: axis -> (from, to)."""
    moving = lambda a, p, q: f"CASE WHEN {q} <> {p} THEN {{0}}((lo_{a} - {p}) / nullif({q} - {p}, 0), (hi_{a} - {p}) / nullif({q} - {p}, 0)) END"
    first = ", ".join(f"coalesce({moving(a, p, q).format('least')}, 0.0)" for a, (p, q) in ends.items())
    last = ", ".join(f"coalesce({moving(a, p, q).format('greatest')}, 1.0)" for a, (p, q) in ends.items())
    still = " AND ".join(f"({q} <> {p} OR ({p} >= lo_{a} AND {p} <= hi_{a}))" for a, (p, q) in ends.items())
    return f"({still} AND greatest(0.0, {first}) <= least(1.0, {last}))"


@query(f"WITH {_box_sql(_LIN, 'lin', 'xy', lambda a: f'least({a}a, {a}b)', lambda a: f'greatest({a}a, {a}b)')} SELECT annotation_id, cell_x, cell_y FROM cand WHERE {_slab_sql({a: (a + 'a', a + 'b') for a in 'xy'})}")
def cells_line(spark, d):
    return _cells(lines(spark, d), XY, "line")


@query(
    f"WITH {_VER}, poly AS (SELECT annotation_id, min(x) AS nx, max(x) AS mx, min(y) AS ny, max(y) AS my, count(*) AS n FROM ver GROUP BY 1), "
    f"{_box_sql('seg AS (SELECT annotation_id, x AS x1, y AS y1, lead(x) OVER o AS x2, lead(y) OVER o AS y2 FROM ver WINDOW o AS (PARTITION BY annotation_id ORDER BY vertex))', 'poly', 'xy', lambda a: 'n' + a, lambda a: 'm' + a)} "
    f"SELECT DISTINCT annotation_id, cell_x, cell_y FROM (SELECT cand.*, x1, y1, x2, y2 FROM cand JOIN seg USING (annotation_id)) WHERE n = 1 OR (x2 IS NOT NULL AND {_slab_sql({a: (a + '1', a + '2') for a in 'xy'})})"
)
def cells_polyline(spark, d):
    return _cells(collect_vertices(vertices(spark, d), XY), XY, "polyline")


@query(f"WITH e AS (SELECT vec_id AS annotation_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS t FROM embeddings), b AS (SELECT {', '.join(f'min({a}) AS l{a}, ((max({a}) - min({a})) / 8)::FLOAT::DOUBLE AS c{a}' for a in 'xyzt')} FROM e) SELECT annotation_id, {', '.join(f'greatest(least(floor(({a} - l{a}) / c{a}), 7), 0)::INT AS cell_{a}' for a in 'xyzt')} FROM e, b")
def cells_point_4d(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("annotation_id"), *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyzt")])
    return _cells(e, CoordSpace.of("xyzt"), "point")


# ---- Morton codes and the spatial index

SHAPE = (5, 16, 3)


def _morton_sql(cell, shape):
    return " | ".join(f"(((({c})::BIGINT >> {i}) & 1) << {at})" for c, places in zip(cell, morton.bit_places(shape)) for i, at in enumerate(places)) or "0"


@query(f"SELECT p_partkey, {_morton_sql(['p_partkey % 5', 'p_size % 16', 'p_partkey % 3'], SHAPE)} AS code FROM part")
def morton_encode(spark, d):
    p = _t(spark, d, "part")
    return p.select("p_partkey", morton.encode([F.col("p_partkey") % 5, F.col("p_size") % 16, F.col("p_partkey") % 3], SHAPE).alias("code"))


@query("SELECT p_partkey, " + ", ".join(" | ".join(f"(((p_partkey >> {at}) & 1) << {i})" for i, at in enumerate(places)) + f" AS {a}" for a, places in zip("xyz", morton.bit_places((8, 32, 4)))) + " FROM part")
def morton_decode(spark, d):
    return _t(spark, d, "part").select("p_partkey", *[c.alias(a) for a, c in zip("xyz", morton.decode(F.col("p_partkey"), (8, 32, 4)))])


def _assigned(spark, d):
    df, r, grids = _grids(spark, d)
    leveled = with_level(df, quotas(r["count"], grids, TARGET), F.col("annotation_id"))
    return assign_cells(leveled, XYZ, "point", grids, [r.lower_x, r.lower_y, r.lower_z])


# bits are given by the grid's shape, which the data decide: the cell's axes identify the chunk as its code does
_INDEX = f"{_QUOTA}, r AS (SELECT *, row_number() OVER (ORDER BY annotation_id) - 1 AS rank FROM pts), cell AS (SELECT annotation_id, g.level, {', '.join(f'greatest(least(floor(({a} - l{a}) / w{a}::FLOAT::DOUBLE), g{a} - 1), 0)::INT AS cell_{a}' for a in 'xyz')} FROM r JOIN quota ON rank >= first AND rank < last JOIN g ON g.level = quota.level, b)"


@query(f"WITH RECURSIVE {_INDEX} SELECT level, cell_x, cell_y, cell_z, count(*) AS n FROM cell GROUP BY ALL")
def chunk_counts(spark, d):
    """Annotations of each cell of a multi-level index over events."""
    return _assigned(spark, d).groupBy("level", "cell_x", "cell_y", "cell_z").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {_INDEX}, k AS (SELECT level, cell_x, cell_y, cell_z, count(*) AS n FROM cell GROUP BY ALL) SELECT level, count(*) AS chunks, max(n) AS \"limit\" FROM k GROUP BY level")
def chunk_limit(spark, d):
    return chunk_limits(_assigned(spark, d))


# ---- shard hash

_M = "4294967295"


def _mul(x, c):
    return f"(({x}) * {c}::UBIGINT & {_M}::UBIGINT)"


def _rot(x, n):
    return f"(((({x}) << {n}) | (({x}) >> {32 - n})) & {_M}::UBIGINT)"


def _low64_steps(source):
    """CTEs from ``k(id, key UBIGINT)`` to ``h(id, low UBIGINT)``."""
    f = lambda h: (f"xor({h}, {h} >> 16)", f"xor({h}, {h} >> 13)", f"xor({h}, {h} >> 16)")
    steps = [f"k AS ({source})", f"s1 AS (SELECT id, {_mul(f'key & {_M}::UBIGINT', 597399067)} AS a, {_mul('key >> 32', 2869860233)} AS b FROM k)"]
    steps.append(f"s2 AS (SELECT id, {_rot('a', 15)} AS a, {_rot('b', 16)} AS b FROM s1)")
    steps.append(f"s3 AS (SELECT id, xor(8::UBIGINT, {_mul('a', 2869860233)}) AS a, xor(8::UBIGINT, {_mul('b', 951274213)}) AS b FROM s2)")
    steps.append(f"s4 AS (SELECT id, (a + b + 16) & {_M}::UBIGINT AS a, b FROM s3)")
    steps.append(f"s5 AS (SELECT id, a, (a + b) & {_M}::UBIGINT AS b, (a + 8) & {_M}::UBIGINT AS c FROM s4)")
    for i, const in ((6, 2246822507), (7, 3266489909)):
        steps.append(f"s{i} AS (SELECT id, {', '.join(f'{_mul(f(x)[i - 6], const)} AS {x}' for x in 'abc')} FROM s{i - 1})")
    steps.append(f"s8 AS (SELECT id, {', '.join(f'{f(x)[2]} AS {x}' for x in 'abc')} FROM s7)")
    steps.append(f"s9 AS (SELECT id, (a + b + 2 * c) & {_M}::UBIGINT AS a, b FROM s8)")
    steps.append(f"h AS (SELECT id, a | (((a + b) & {_M}::UBIGINT) << 32) AS low FROM s9)")
    return ", ".join(steps)


@query(f"WITH {_low64_steps('SELECT o_orderkey AS id, o_orderkey::UBIGINT AS key FROM orders')} SELECT id AS o_orderkey, printf('%016x', low) AS hash FROM h")
def murmur_low64(spark, d):
    return with_low64(_t(spark, d, "orders").select("o_orderkey"), F.col("o_orderkey")).select("o_orderkey", F.lower(F.lpad(F.hex("hash"), 16, "0")).alias("hash"))


SPEC = ShardSpec(2, 5, 4)
_SHARD = f"WITH {_low64_steps('SELECT o_orderkey AS id, o_orderkey::UBIGINT >> 2 AS key FROM orders')}, p AS (SELECT id AS o_orderkey, ((low >> 4) & 31)::BIGINT AS shard, (low & 15)::BIGINT AS minishard FROM h) "


@query(_SHARD + "SELECT * FROM p")
def shard_by_id(spark, d):
    return with_shard(_t(spark, d, "orders").select("o_orderkey"), F.col("o_orderkey"), SPEC)


@query(_SHARD + "SELECT shard, minishard, count(*) AS n FROM p GROUP BY ALL")
def shard_histogram(spark, d):
    return with_shard(_t(spark, d, "orders").select("o_orderkey"), F.col("o_orderkey"), SPEC).groupBy("shard", "minishard").agg(F.count(F.lit(1)).alias("n"))


# ---- relationships


def _related(spark, d):
    return _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("annotation_id")).agg(F.collect_list("l_suppkey").alias("suppliers"))


@query("SELECT event_id AS annotation_id, user_id AS segment FROM events WHERE user_id % 5 <> 0")
def rel_scalar_pairs(spark, d):
    df = points(spark, d).withColumn("user", F.when(F.col("user_id") % 5 != 0, F.col("user_id")))
    return pairs(df, "user", "annotation_id")


@query("SELECT DISTINCT l_orderkey AS annotation_id, l_suppkey AS segment FROM lineitem")
def rel_list_pairs(spark, d):
    return pairs(_related(spark, d), "suppliers", "annotation_id")


@query("SELECT l_suppkey AS segment, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1")
def rel_group_counts(spark, d):
    return group_counts(_related(spark, d), "suppliers")


@query(f"WITH {_VER} SELECT annotation_id, count(*) AS vertices FROM ver WHERE annotation_id % 3 = 0 GROUP BY 1")
def polyline_orphans(spark, d):
    """Vertices whose polyline is not in the main table are dropped, and polylines without vertices."""
    users = _t(spark, d, "events").select("user_id").distinct()
    ids = users.select(F.explode(F.sequence(F.col("user_id") * 8, F.col("user_id") * 8 + 7)).alias("annotation_id"))
    main = ids.where(F.col("annotation_id") % 3 == 0)
    return with_vertices(main, vertices(spark, d), XY).select("annotation_id", F.size("vertices").cast("long").alias("vertices"))


@query("SELECT event_id AS annotation_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def restrict_ids(spark, d):
    ids = _t(spark, d, "customer").where(F.col("c_nationkey") == 3).select(F.col("c_custkey").alias("user_id"))
    return restrict_to(points(spark, d), ids, "user_id").select("annotation_id", "user_id")


# ---- records

LABELS = ["O", "F", "P"]


def _order_points(spark, d):
    o = _t(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("annotation_id"), F.col("o_totalprice").alias("x"), (F.col("o_orderkey") % 97).cast("double").alias("y"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 1000).cast("smallint").alias("tag"), F.col("o_custkey").alias("customer"))


@query("SELECT o_orderkey AS annotation_id, (CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 WHEN 'P' THEN 2 END)::INT AS code FROM orders")
def enum_codes(spark, d):
    """Enum codes as the records hold them, read back from the bytes."""
    df = _order_points(spark, d)
    specs = property_specs(df, [{"id": "status", "enum_labels": LABELS}])
    r = encode_records(df, XY, "point", specs, ["annotation_id"])
    return r.select("annotation_id", F.conv(F.hex(F.substring("record", 9, 1)), 16, 10).cast("int").alias("code"))


@query("SELECT * FROM (VALUES (0, 'a_f32', 'float32', 4), (1, 'a_i32', 'int32', 4), (2, 'a_u32', 'uint32', 4), (3, 'a_i16', 'int16', 2), (4, 'a_kind', 'uint8', 1), (5, 'a_rgb', 'rgb', 3)) t(position, id, type, bytes)")
def property_layout(spark, d):
    from annospark.plans.model import PROPERTY_TYPES

    df = _t(spark, d, "orders").select(F.lit("F").alias("a_kind"), F.lit("#ffffff").alias("a_rgb"), F.lit(1).cast("smallint").alias("a_i16"), F.lit(1).cast("bigint").alias("a_u32"), F.lit(1.0).cast("float").alias("a_f32"), F.lit(1).alias("a_i32"))
    specs = property_specs(df, [{"id": "a_kind", "enum_labels": LABELS}, {"id": "a_rgb", "type": "rgb"}, "a_i16", {"id": "a_u32", "type": "uint32"}, "a_f32", "a_i32"])
    return spark.createDataFrame([(i, s["id"], s["type"], PROPERTY_TYPES[s["type"]][0]) for i, s in enumerate(specs)], "position int, id string, type string, bytes int")


@query("SELECT o_orderkey AS annotation_id, 12 + 4 + 8 AS bytes, o_custkey AS related FROM orders")
def by_id_bytes(spark, d):
    """Size of each id value (2 coordinates, int16 and uint8 properties padded, one related id), and the id in it."""
    df = _order_points(spark, d)
    specs = property_specs(df, [{"id": "status", "enum_labels": LABELS}, "tag"])
    r = encode_records(df, XY, "point", specs, ["annotation_id"], ["customer"])
    tail = F.substring("record", 17, 8)
    swapped = F.concat(*[F.hex(F.substring(tail, 8 - i, 1)) for i in range(8)])
    return r.select("annotation_id", F.length("record").alias("bytes"), F.conv(swapped, 16, 10).cast("long").alias("related"))


@query("SELECT o_custkey AS segment, count(*) AS n, (8 + count(*) * (12 + 8))::INT AS bytes FROM orders GROUP BY 1")
def group_bytes(spark, d):
    """Members and size of each related-segment value."""
    df = _order_points(spark, d)
    specs = property_specs(df, [{"id": "status", "enum_labels": LABELS}, "tag"])
    r = encode_records(pairs(df, "customer", "annotation_id", "x", "y", "status", "tag"), XY, "point", specs, ["segment", "annotation_id"])
    g = group_frame(r, ["segment"], ["annotation_id"])
    return g.select("segment", "n", F.length("value").alias("bytes"))


def _scratch(spark) -> str:
    """A fresh folder that executors share: under spark.checkpoint.dir, else, in local mode alone, a temporary one."""
    import tempfile
    import uuid

    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return f"{at.rstrip('/')}/annospark-export-{uuid.uuid4().hex[:12]}"
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="annospark-export-")


@query("SELECT o_orderkey AS key, 24 AS bytes FROM orders")
def sharded_roundtrip(spark, d):
    """A whole export, of which the id index is read back from its shards."""
    at = _scratch(spark)
    df = _order_points(spark, d)
    info = export_annotations(df, XY, "point", [{"id": "status", "enum_labels": LABELS}, "tag"], ["customer"], at, num_spatial_levels=4, target_chunk_limit=200)
    s = info["by_id"]["sharding"]
    return read_sharded(spark, f"{at}/by_id", ShardSpec(s["preshift_bits"], s["shard_bits"], s["minishard_bits"])).select("key", F.length("value").alias("bytes"))


# ---- segment properties

TAGS = ["brand", "kind", "is large"]
_SEG = "seg AS (SELECT p_partkey AS segment, p_name AS name, p_brand AS brand, p_type AS kind, p_size > 25 AS is_large, p_size AS size, p_retailprice AS price FROM part)"
_LONG = "lt AS (SELECT segment, 1 AS pos, 'brand:' || replace(brand, ' ', '_') AS tag, replace(brand, ' ', '_') AS value FROM seg WHERE brand <> '' UNION ALL SELECT segment, 2, 'kind:' || replace(kind, ' ', '_'), replace(kind, ' ', '_') FROM seg WHERE kind <> '' UNION ALL SELECT segment, 3, 'is_large', 'is_large' FROM seg WHERE is_large)"
_DICT = "dict AS (SELECT tag, row_number() OVER (ORDER BY pos, value) - 1 AS code FROM (SELECT DISTINCT pos, value, tag FROM lt))"


@query("SELECT p_partkey AS segment FROM part WHERE p_partkey % 4 <> 0 OR p_size > 25")
def seg_drop_empty(spark, d):
    df = segments(spark, d).select("segment", F.when(F.col("segment") % 4 != 0, F.col("name")).otherwise("").alias("name"), "is large")
    return segprops.drop_empty(df).select("segment")


@query(f"WITH {_SEG}, {_LONG}, {_DICT} SELECT tag, code::INT AS code FROM dict")
def seg_tags_dict(spark, d):
    return segprops.tag_dictionary(segments(spark, d), TAGS).select("tag", "code")


@query(f"WITH {_SEG}, {_LONG}, {_DICT} SELECT segment, array_to_string(list_sort(list(code)), ',') AS codes FROM lt JOIN dict USING (tag) GROUP BY 1")
def seg_tag_codes(spark, d):
    df = segments(spark, d)
    return segprops.tag_codes(df, segprops.tag_dictionary(df, TAGS), TAGS).select("segment", F.concat_ws(",", F.col("codes").cast("array<string>")).alias("codes"))


@query(
    "WITH s AS (SELECT c_custkey AS segment, c_mktsegment AS a, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'own' END AS b FROM customer), lt AS (SELECT segment, 1 AS pos, 'a' AS col, a AS value FROM s UNION ALL SELECT segment, 2, 'b', b FROM s), "
    "v AS (SELECT DISTINCT pos, col, value FROM lt), m AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY value) > 1 THEN col || ':' || value ELSE value END AS tag FROM v), dict AS (SELECT *, row_number() OVER (ORDER BY tag) - 1 AS code FROM m) "
    "SELECT segment, array_to_string(list_sort(list(code)), ',') AS codes FROM lt JOIN dict USING (pos, value) GROUP BY 1"
)
def seg_tag_codes_disambiguated(spark, d):
    c = _t(spark, d, "customer")
    df = c.select(F.col("c_custkey").alias("segment"), F.col("c_mktsegment").alias("a"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("own").alias("b"))
    dictionary = segprops.tag_dictionary(df, ["a", "b"], "disambiguate", sort=True)
    return segprops.tag_codes(df, dictionary, ["a", "b"]).select("segment", F.concat_ws(",", F.col("codes").cast("array<string>")).alias("codes"))


@query("SELECT * FROM (VALUES ('big', 'uint32'), ('price', 'float32'), ('size', 'int32')) t(col, type)")
def seg_number_type(spark, d):
    df = segments(spark, d).withColumn("big", F.col("segment") + F.lit(1 << 31))
    return spark.createDataFrame(sorted(segprops.number_types(df, ["big", "price", "size"]).items()), "col string, type string")


def _document(spark, d):
    return segprops.segment_document(segments(spark, d), "name", tags=TAGS)


@query(f"WITH {_SEG} SELECT segment, name, replace(brand, ' ', '_') AS brand, replace(kind, ' ', '_') AS kind, CASE WHEN is_large THEN 'is_large' END AS is_large, size, round(price::FLOAT::DOUBLE, 2) AS price FROM seg")
def seg_roundtrip(spark, d):
    """Table to document to table: tags come back in a column for each prefix."""
    return segprops.segment_table(spark, _document(spark, d)).select("segment", "name", "brand", "kind", "is_large", "size", F.round(F.col("price").cast("double"), 2).alias("price"))


@query(f"WITH {_SEG} SELECT segment, trim(replace(brand, ' ', '_') || ' / ' || name) AS label FROM seg")
def seg_select_template(spark, d):
    full = segprops.segment_table(spark, _document(spark, d))
    return select.with_expressions(full, {"label": "{brand} / {name}"}, ["segment"])


@query(f"WITH {_SEG} SELECT segment, (size * 2 + 1)::INT AS twice, (size > 10 AND size <= 30) OR replace(brand, ' ', '_') IN ('Brand#11', 'Brand#23') AS pick FROM seg")
def seg_select_expr(spark, d):
    full = segprops.segment_table(spark, _document(spark, d))
    return select.with_expressions(full, {"twice": "size * 2 + 1", "pick": "(10 < size <= 30) or brand in ('Brand#11', 'Brand#23')"}, ["segment"]).withColumn("twice", F.col("twice").cast("int"))


@query("SELECT col FROM (SELECT 'name' AS col, count(DISTINCT p_name) AS n FROM part UNION ALL SELECT 'brand', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'kind', count(DISTINCT p_type) FROM part UNION ALL SELECT 'is_large', 2 UNION ALL SELECT 'size', count(DISTINCT p_size) FROM part UNION ALL SELECT 'price', count(DISTINCT p_retailprice::FLOAT) FROM part) WHERE n <= 1000")
def seg_default_macro(spark, d):
    full = segprops.segment_table(spark, _document(spark, d))
    return spark.createDataFrame([(c,) for c in select.expand_macros(full, ["_default"], ["segment"])], "col string")


@query("SELECT p_partkey AS segment FROM part")
def seg_select_properties(spark, d):
    """Document to document with computed scalars and tags; the ids that stay."""
    info = select.select_properties(spark, _document(spark, d), ["_default_tags", "size"], {"label": "{name}"}, {"heavy": "size > 25"})
    return segprops.segment_table(spark, info).select("segment")


# ---- colours, local layers


def _color_sql():
    mul, rot = _mul, _rot
    steps = ["c0 AS (SELECT p_partkey AS segment, 0::UBIGINT AS s, p_partkey::UBIGINT AS id FROM part)"]
    value = ["id & 4294967295::UBIGINT", "id >> 32"]
    for r in (0, 1):
        b = f"c{3 * r}"
        steps.append(f"c{3 * r + 1} AS (SELECT *, {mul(value[r], 3432918353)} AS v{r} FROM {b})")
        steps.append(f"c{3 * r + 2} AS (SELECT *, xor({'s' if not r else 's1'}, {mul(rot(f'v{r}', 15), 461845907)}) AS x{r} FROM c{3 * r + 1})")
        steps.append(f"c{3 * r + 3} AS (SELECT *, ({rot(f'x{r}', 13)} * 5 + 3864292196::UBIGINT) & 4294967295::UBIGINT AS s{r + 1} FROM c{3 * r + 2})")
    steps.append("q AS (SELECT segment, (s2 & 255)::DOUBLE / 255.0::DOUBLE * 6 AS h, 0.5::DOUBLE + 0.5::DOUBLE * (((s2 >> 8) & 255)::DOUBLE / 255.0::DOUBLE) AS s FROM c6)")
    steps.append("w AS (SELECT segment, floor(h)::INT % 6 AS i, 1 - s AS a, 1 - s * (h - floor(h)) AS b, 1 - s * (1 - (h - floor(h))) AS c FROM q)")
    channel = lambda order: "CASE i " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(order)) + " END"
    cols = [channel(x) for x in (["1", "b", "a", "a", "c", "1"], ["c", "1", "1", "b", "a", "a"], ["a", "a", "c", "1", "1", "b"])]
    return f"WITH {', '.join(steps)} SELECT segment, '#' || " + " || ".join(f"printf('%02x', round_even(({x})::DOUBLE * 255, 0)::INT)" for x in cols) + " AS color FROM w"


@query(_color_sql())
def segment_color_hex(spark, d):
    return with_color(_t(spark, d, "part").select(F.col("p_partkey").alias("segment")), F.col("segment"))


@query("SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'point' WHEN 1 THEN 'ellipsoid' WHEN 2 THEN 'axis_aligned_bounding_box' ELSE 'line' END AS type FROM events")
def local_type_inference(spark, d):
    e, k = _t(spark, d, "events"), F.col("event_id") % 4
    near = lambda ok, c: F.when(ok, F.col(c).cast("double"))
    df = e.select(F.col("event_id").alias("id"), *[near(k <= 1, "value").alias(a) for a in "xyz"], *[near(k == 1, "value").alias(f"r{a}") for a in "xyz"], *[near(k >= 2, "value").alias(f"{a}{s}") for a in "xyz" for s in "ab"], F.when(k == 3, "line").alias("type"))
    return local.standardize(df).select(F.col("id").cast("long").alias("id"), "type")


@query("SELECT user_id::BIGINT AS link_index, event_type AS layer, 'point' AS type, event_id::VARCHAR AS id, value AS x, event_id::DOUBLE AS y, 0.5::DOUBLE AS z FROM events WHERE event_type <> 'view'")
def local_extract(spark, d):
    """States of one layer for each user and event type, taken apart again; layers of 'view' are hidden."""
    e = _t(spark, d, "events")
    a = F.struct(F.lit("point").alias("type"), F.col("event_id").cast("string").alias("id"), F.array(F.col("value"), F.col("event_id").cast("double"), F.lit(0.5)).alias("point"))
    layer = e.groupBy("user_id", "event_type").agg(F.collect_list(a).alias("annotations"))
    layer = layer.select("user_id", F.struct(F.lit("annotation").alias("type"), F.col("event_type").alias("name"), (F.col("event_type") != "view").alias("visible"), "annotations").alias("l"))
    states = layer.groupBy(F.col("user_id").cast("long").alias("link_index")).agg(F.to_json(F.struct(F.collect_list("l").alias("layers"))).alias("state"))
    return local.extract_states(states, "state", visible_only=True, keep=["link_index"]).select("link_index", "layer", "type", "id", "x", "y", "z")


def summary_of_points(spark: SparkSession, d: str):
    return summarize(points(spark, d), XYZ, "point")
