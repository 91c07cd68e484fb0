"""Registered queries over files and documents: exports read back, sources, local layers, links, scripts, segment documents.

Importing this module registers them beside those of :mod:`annospark.plans.queries`.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from annospark.functions import colors, morton
from annospark.functions.shardhash import ShardSpec, choose_spec
from annospark.operators import local, segprops, select
from annospark.operators.bounds import summarize
from annospark.operators.cells import assign_cells, dropped_polylines
from annospark.operators.decode import group_rows, id_rows, polyline_rows
from annospark.plans.export import export_annotations
from annospark.plans.queries import _GRID, _INDEX, _LIN, _SEG, _VER, LABELS, LEVELS, TAGS, TARGET, XY, XYZ, _box_sql, _color_sql, _document, _one_grid, _order_points, _related, _scratch, _slab_sql, _t, lines, points, query, segments, vertices
from annospark.sources import links, publish, tables, video
from annospark.sources.shards import read_files, read_sharded, read_sharded_groups

PROPERTIES = [{"id": "status", "enum_labels": LABELS}, "tag"]
#: Two coordinates, an int16 and a uint8, padded to 4 bytes.
RECORD = 12


def _spec(entry) -> ShardSpec:
    s = entry["sharding"]
    return ShardSpec(s["preshift_bits"], s["shard_bits"], s["minishard_bits"])


def _little(c, start: int, n: int):
    """An unsigned little-endian number in a binary column."""
    return F.conv(F.concat(*[F.hex(F.substring(c, start + n - 1 - i, 1)) for i in range(n)]), 16, 10).cast("long")


def _xy(df):
    return df.withColumns({"x": F.col("coords")[0].cast("double"), "y": F.col("coords")[1].cast("double")})


# ---- exports, read back

_ORD = "ord AS (SELECT o_orderkey AS id, o_totalprice::FLOAT::DOUBLE AS x, (o_orderkey % 97)::FLOAT::DOUBLE AS y, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END::BIGINT AS status, (o_orderkey % 1000)::BIGINT AS tag, o_custkey AS customer FROM orders)"


@query(f"WITH {_ORD} SELECT id AS key, x, y, status, tag, customer FROM ord")
def export_by_id(spark, d):
    """Coordinates, properties and related ids of the sharded id index."""
    at = _scratch(spark)
    info = export_annotations(_order_points(spark, d), XY, "point", PROPERTIES, ["customer"], at, write_by_relationship=False, write_by_spatial_chunk=False)
    rows = _xy(id_rows(read_sharded(spark, f"{at}/by_id", _spec(info["by_id"])), RECORD, 2, 1))
    return rows.select("key", "x", "y", _little("rest", 3, 1).alias("status"), _little("rest", 1, 2).alias("tag"), F.col("related")[0][0].alias("customer"))


@query(f"WITH {_ORD} SELECT id::VARCHAR AS name, x, y, status, tag, customer FROM ord WHERE id % 16 = 1")
def export_by_id_files(spark, d):
    """The same of an index with a file a key."""
    at = _scratch(spark)
    export_annotations(_order_points(spark, d).where("annotation_id % 16 = 1"), XY, "point", PROPERTIES, ["customer"], at, False, write_by_relationship=False, write_by_spatial_chunk=False)
    rows = _xy(id_rows(read_files(spark, f"{at}/by_id"), RECORD, 2, 1, "name"))
    return rows.select("name", "x", "y", _little("rest", 3, 1).alias("status"), _little("rest", 1, 2).alias("tag"), F.col("related")[0][0].alias("customer"))


_REL = f"WITH {_ORD} SELECT customer{{0}} AS segment, row_number() OVER (PARTITION BY customer ORDER BY id) - 1 AS seq, id, x, y, status, tag FROM ord"


def _members(rows, segment):
    return _xy(rows).select(segment, "seq", "id", "x", "y", _little("rest", 3, 1).alias("status"), _little("rest", 1, 2).alias("tag"))


@query(_REL.format(""))
def export_relationships(spark, d):
    """Members of each related-segment value in order of their ids, from its shards."""
    at = _scratch(spark)
    info = export_annotations(_order_points(spark, d), XY, "point", PROPERTIES, ["customer"], at, write_by_id=False, write_by_spatial_chunk=False)
    part = info["relationships"][0]
    return _members(read_sharded_groups(spark, f"{at}/{part['key']}", _spec(part), RECORD, 2), F.col("key").alias("segment"))


@query(_REL.format("::VARCHAR") + " WHERE customer % 8 = 1")
def export_relationships_files(spark, d):
    at = _scratch(spark)
    export_annotations(_order_points(spark, d).where("customer % 8 = 1"), XY, "point", PROPERTIES, ["customer"], at, False, write_by_id=False, write_by_spatial_chunk=False)
    return _members(group_rows(read_files(spark, f"{at}/by_rel_customer"), RECORD, 2, ["name"]), F.col("name").alias("segment"))


@query("SELECT segment, row_number() OVER (PARTITION BY segment ORDER BY id) - 1 AS seq, id FROM (SELECT DISTINCT l_suppkey AS segment, l_orderkey AS id FROM lineitem)")
def export_list_relationship(spark, d):
    """A list relationship: an annotation comes once for each of its segments, however often it names it."""
    at = _scratch(spark)
    df = _related(spark, d).withColumns({"x": F.col("annotation_id").cast("double"), "y": F.lit(1.0)})
    info = export_annotations(df, XY, "point", [], ["suppliers"], at, write_by_id=False, write_by_spatial_chunk=False)
    part = info["relationships"][0]
    return read_sharded_groups(spark, f"{at}/{part['key']}", _spec(part), 8, 2).select(F.col("key").alias("segment"), "seq", "id")


_CELL = f"WITH RECURSIVE {_INDEX} SELECT c.level, cell_x, cell_y, cell_z, row_number() OVER (PARTITION BY c.level, cell_x, cell_y, cell_z ORDER BY c.annotation_id) - 1 AS seq, c.annotation_id AS id, x::FLOAT::DOUBLE AS x, y::FLOAT::DOUBLE AS y FROM cell c JOIN pts USING (annotation_id)"


def _spatial(spark, d, sharded, read):
    at, out = _scratch(spark), None
    info = export_annotations(points(spark, d), XYZ, "point", [], [], at, sharded, write_by_id=False, num_spatial_levels=LEVELS, target_chunk_limit=TARGET, shuffle_spatial_ordering=False)
    for level, part in enumerate(info["spatial"]):
        rows = _xy(read(f"{at}/{part['key']}", part)).select(F.lit(level).alias("level"), *[F.col(f"cell_{a}").cast("int").alias(f"cell_{a}") for a in "xyz"], "seq", "id", "x", "y")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(_CELL)
def export_spatial(spark, d):
    """Members of each chunk of a multi-level index in order of their ids, from its shards; the cell is decoded from the key."""

    def read(at, part):
        rows = read_sharded_groups(spark, at, _spec(part), 12, 3)
        return rows.withColumns({f"cell_{a}": c for a, c in zip("xyz", morton.decode(F.col("key"), tuple(part["grid_shape"])))})

    return _spatial(spark, d, True, read)


@query(_CELL)
def export_spatial_files(spark, d):
    """The same of an index with a file a chunk, named by its cell."""

    def read(at, part):
        rows = group_rows(read_files(spark, at), 12, 3, ["name"])
        return rows.withColumns({f"cell_{a}": F.split("name", "_")[i] for i, a in enumerate("xyz")})

    return _spatial(spark, d, False, read)


@query(f"WITH RECURSIVE {_INDEX} SELECT level, count(*) AS n, count(DISTINCT annotation_id) AS ids FROM cell GROUP BY level")
def export_spatial_shuffled(spark, d):
    """Members of each level where order is drawn at random: the quotas, each annotation once."""
    at, out = _scratch(spark), None
    info = export_annotations(points(spark, d), XYZ, "point", [], [], at, write_by_id=False, num_spatial_levels=LEVELS, target_chunk_limit=TARGET, seed=5)
    for level, part in enumerate(info["spatial"]):
        rows = read_sharded_groups(spark, f"{at}/{part['key']}", _spec(part), 12, 3).select(F.lit(level).alias("level"), "id")
        out = rows if out is None else out.unionByName(rows)
    out = out.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "level", "id")  # else a task holds the distinct ids of a shard
    return out.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


@query(f"WITH RECURSIVE {_GRID} SELECT {', '.join(f'min({a}) AS lower_{a}, max({a}) AS upper_{a}' for a in 'xyz')}, 'point' AS kind, (SELECT count(*) FROM g WHERE level < {LEVELS}) >= 1 AS leveled FROM pts")
def export_info(spark, d):
    """``info`` as it lies in its file."""
    at = _scratch(spark)
    export_annotations(points(spark, d), XYZ, "point", [], [], at, write_by_id=False, num_spatial_levels=LEVELS, target_chunk_limit=TARGET)
    doc = spark.read.option("wholetext", True).text(f"{at}/info")
    info = doc.select(F.from_json("value", "annotation_type string, lower_bound array<double>, upper_bound array<double>, spatial array<struct<key:string,limit:long>>").alias("i"))
    ends = [F.col(f"i.{side}_bound")[k].alias(f"{side}_{a}") for k, a in enumerate("xyz") for side in ("lower", "upper")]
    return info.select(*ends, F.col("i.annotation_type").alias("kind"), (F.size("i.spatial") >= 1).alias("leveled"))


@query(f"WITH {_VER} SELECT annotation_id AS key, row_number() OVER (PARTITION BY annotation_id ORDER BY vertex) - 1 AS pos, x::FLOAT::DOUBLE AS x, y::FLOAT::DOUBLE AS y FROM ver")
def export_polylines(spark, d):
    """Every vertex of every polyline, in order, from the id index."""
    at = _scratch(spark)
    info = export_annotations(None, XY, "polyline", output_dir=at, polyline_points=vertices(spark, d), write_by_spatial_chunk=False)
    rows = polyline_rows(read_sharded(spark, f"{at}/by_id", _spec(info["by_id"])), 2)
    return rows.select("key", F.posexplode("vertices").alias("pos", "v")).select("key", F.col("pos").cast("long").alias("pos"), F.col("v")[0].cast("double").alias("x"), F.col("v")[1].cast("double").alias("y"))


@query(f"WITH {_VER}, i AS (SELECT DISTINCT annotation_id FROM ver), m AS (SELECT annotation_id FROM i WHERE annotation_id % 3 = 0 UNION ALL SELECT -n_nationkey - 1 FROM nation) SELECT (SELECT count(*) FROM m WHERE annotation_id < 0) AS polylines, (SELECT count(*) FROM i WHERE annotation_id % 3 <> 0) AS vertex_groups")
def polylines_dropped(spark, d):
    """Polylines without vertices, and groups of vertices without a polyline."""
    v = vertices(spark, d)
    main = v.select("annotation_id").distinct().where("annotation_id % 3 = 0").unionByName(_t(spark, d, "nation").select((-F.col("n_nationkey") - 1).cast("long").alias("annotation_id")))
    return dropped_polylines(main, v)


# ---- keys, layouts, compatibility


@query("SELECT (max(o_orderkey::HUGEINT + CASE WHEN o_orderkey % 3 = 0 THEN 9223372036854775808::HUGEINT ELSE 0 END))::VARCHAR AS max_id, count(*) AS n FROM orders")
def unsigned_max_id(spark, d):
    """Ids above the signed range are the largest."""
    df = _order_points(spark, d).withColumn("annotation_id", F.when(F.col("annotation_id") % 3 == 0, F.col("annotation_id").bitwiseOR(F.lit(-(1 << 63)))).otherwise(F.col("annotation_id")))
    s = summarize(df, XY, "point")
    return spark.createDataFrame([(str(s.max_id), s.count)], "max_id string, n long")


_SIZES = "s AS (SELECT c_nationkey AS nation, count(*)::BIGINT * 40000 AS n, (count(*) * 40000 * 9000)::BIGINT AS bytes, max(c_custkey) AS top FROM customer GROUP BY 1)"


@query(f"WITH {_SIZES}, b AS (SELECT nation, top, (SELECT min(i) FROM range(65) t(i) WHERE n // (2::HUGEINT ** i)::HUGEINT <= 1000) AS groups, (SELECT min(i) FROM range(65) t(i) WHERE bytes // (2::HUGEINT ** i)::HUGEINT <= 50000000) AS shard_bits FROM s), m AS (SELECT *, greatest(groups - shard_bits, 0) AS minishard_bits FROM b) SELECT nation, shard_bits::INT AS shard_bits, minishard_bits::INT AS minishard_bits, least(10, greatest(0, length(bin(top)) - shard_bits - minishard_bits))::INT AS preshift_bits FROM m")
def shard_spec(spark, d):
    """Layout of an index of so many keys and bytes, for each nation."""
    sizes = _t(spark, d, "customer").groupBy("c_nationkey").agg((F.count(F.lit(1)) * 40000).alias("n"), F.max("c_custkey").alias("top")).collect()
    specs = [(r.c_nationkey, choose_spec(r.n, r.n * 9000, r.top)) for r in sizes]
    return spark.createDataFrame([(int(k), s.shard_bits, s.minishard_bits, s.preshift_bits) for k, s in specs], "nation long, shard_bits int, minishard_bits int, preshift_bits int").withColumn("nation", F.col("nation").cast(_t(spark, d, "customer").schema["c_nationkey"].dataType))


@query(f"WITH {_box_sql(_LIN, 'lin', 'xy', lambda a: f'least({a}a, {a}b)', lambda a: f'greatest({a}a, {a}b)')} SELECT annotation_id, cell_x, cell_y FROM cand WHERE {_slab_sql({a: (f'least({a}a, {a}b)', f'greatest({a}a, {a}b)') for a in 'xy'})}")
def cells_line_compat(spark, d):
    """Lines whose end points are ordered on each axis by itself."""
    df = lines(spark, d)
    grids, lower = _one_grid(df, XY, "line")
    return assign_cells(df.withColumn("level", F.lit(0)), XY, "line", grids, lower, compat=True).select("annotation_id", "cell_x", "cell_y")


# ---- sources

_NATIONS = "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS annotation_id, n_name AS name, n_regionkey::BIGINT AS region FROM nation"


def _nations(spark, d):
    return _t(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"), "n_nationkey").orderBy("n_nationkey").drop("n_nationkey")


@query(_NATIONS)
def source_pandas(spark, d):
    """Ids from the positions of a data frame."""
    return tables.from_pandas(spark, _nations(spark, d).toPandas()).select("annotation_id", "name", "region")


@query("SELECT n_nationkey * 10 + 5 AS annotation_id, n_name AS name, n_regionkey::BIGINT AS region FROM nation")
def source_feather(spark, d):
    """Ids from the index of a Feather file."""
    import pyarrow as pa
    import pyarrow.feather

    pdf = _nations(spark, d).toPandas()
    pdf.index = range(5, 10 * len(pdf) + 5, 10)
    at = _scratch(spark).removeprefix("file://") + ".feather"
    with pa.OSFile(at, "wb") as f:
        pyarrow.feather.write_feather(pa.Table.from_pandas(pdf), f)
    return tables.read_annotations(spark, at).select("annotation_id", "name", "region")


@query(_NATIONS)
def source_parquet_files(spark, d):
    """Ids from the positions in a table of several files."""
    at = _scratch(spark)
    _t(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"), "n_nationkey").repartitionByRange(4, "n_nationkey").sortWithinPartitions("n_nationkey").write.parquet(at)
    return tables.from_parquet(spark, at).select("annotation_id", "name", "region")


@query("SELECT o_orderkey AS annotation_id, o_orderstatus AS status FROM orders")
def source_named_ids(spark, d):
    """A table that Spark reads, with the id in a column of another name."""
    return tables.read_annotations(spark, f"{d}/orders.parquet", "o_orderkey").select("annotation_id", F.col("o_orderstatus").alias("status"))


# ---- local layers


def _few_points(spark, d):
    return _t(spark, d, "events").where("event_id % 50 = 0").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"), F.lit(2.0).alias("z"), F.col("event_type").alias("description"), F.array(F.col("user_id")).alias("segments"))


@query("SELECT event_id::VARCHAR AS id, 'point' AS type, user_id::DOUBLE AS x, value AS y, 2.0::DOUBLE AS z, event_type AS description, user_id::VARCHAR AS segment FROM events WHERE event_id % 50 = 0")
def local_layer_json(spark, d):
    """A layer's document, and the annotations in it."""
    layer = local.local_layer(_few_points(spark, d), "l", linked_layer="seg", order_col="id")
    doc = spark.createDataFrame([(json.dumps(layer),)], "j string")
    rows = doc.select(F.explode(F.from_json("j", "annotations array<struct<type:string,id:string,description:string,point:array<double>,segments:array<string>>>")["annotations"]).alias("a"))
    return rows.select("a.id", "a.type", *[F.col("a.point")[i].alias(c) for i, c in enumerate("xyz")], "a.description", F.col("a.segments")[0].alias("segment"))


@query("SELECT event_id::VARCHAR AS id, user_id AS x, value AS y, 2::BIGINT AS z FROM events WHERE event_id % 50 = 0")
def local_narrowed(spark, d):
    """Whole-numbered axes become longs, empty ones go."""
    df = _few_points(spark, d)
    for c in local.COORDS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    return local.narrow_coordinates(df).drop("description", "segments")


@query("SELECT * FROM (VALUES (0, 'link_index'), (1, 'user'), (2, 'layer'), (3, 'type'), (4, 'x'), (5, 'y'), (6, 'z'), (7, 'id'), (8, 'description')) t(position, name)")
def local_columns(spark, d):
    """Columns of extracted annotations, in their order."""
    layer = local.local_layer(_few_points(spark, d).limit(5), "l")
    df = local.extract_annotations(spark, {"layers": [layer]}, link_index=3, user="u")
    return spark.createDataFrame(list(enumerate(df.columns)), "position int, name string")


@query("SELECT DISTINCT CASE event_id % 4 WHEN 0 THEN 'point' WHEN 1 THEN 'line' WHEN 2 THEN 'axis_aligned_bounding_box' ELSE 'ellipsoid' END AS type, true AS called FROM events UNION ALL SELECT 'none', false")
def local_shader(spark, d):
    """A shader calls the functions of the types that it is for, and of no other."""
    own = {"point": "setPointMarker", "line": "setLineColor", "axis_aligned_bounding_box": "setBoundingBox", "ellipsoid": "setEllipsoid"}
    kinds = [r.t for r in _t(spark, d, "events").select(F.element_at(F.lit(list(own)), (F.col("event_id") % 4 + 1).cast("int")).alias("t")).distinct().collect()]
    rows = [(t, own[t] in local.default_shader([t]) and not any(own[o] in local.default_shader([t]) for o in own if o != t)) for t in kinds]
    return spark.createDataFrame([*rows, ("none", any(x in local.default_shader([]) for x in own.values()))], "type string, called boolean")


# ---- colours


@query(f"SELECT segment, {' + '.join(f'{256 ** (2 - k)} * {c}' for k, c in enumerate('rgb'))} AS packed, r::INT AS r, g::INT AS g, b::INT AS b FROM (SELECT segment, " + ", ".join(f"(strpos('0123456789abcdef', substr(color, {2 + 2 * k}, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(color, {3 + 2 * k}, 1)) - 1 AS {c}" for k, c in enumerate("rgb")) + f" FROM ({_color_sql()}))")
def segment_color_packed(spark, d):
    df = colors.with_color(_t(spark, d, "part").select(F.col("p_partkey").alias("segment")), F.col("segment"))
    return df.select("segment", colors.packed(F.col("color")).alias("packed"), *[c.alias(n) for n, c in zip("rgb", colors.unpack(F.col("color")))])


# ---- links, states, scripts


def _states(spark, d):
    """A state for each nation: a layer for each of its suppliers, and one of segments."""
    s = _t(spark, d, "supplier").select("s_nationkey", F.struct(F.lit("annotation").alias("type"), F.concat(F.lit("a/ "), F.col("s_name"), F.lit(" é+*~")).alias("name")).alias("l"))
    own = s.groupBy(F.col("s_nationkey").cast("long").alias("nation")).agg(F.array_append(F.array_sort(F.collect_list("l")), F.struct(F.lit("segmentation").alias("type"), F.lit("seg").alias("name"))).alias("layers"))
    return own.select("nation", F.to_json(F.struct("layers")).alias("state"))


@query("SELECT s_nationkey::BIGINT AS nation, 'a/ ' || s_name || ' é+*~' AS layer, 'annotation' AS type FROM supplier UNION ALL SELECT DISTINCT s_nationkey::BIGINT, 'seg', 'segmentation' FROM supplier")
def link_states(spark, d):
    """States to links to states to layers, all in columns."""
    df = _states(spark, d).select("nation", links.encoded("https://viewer", F.col("state")).alias("link"))
    parsed = df.select("nation", links.decoded(F.col("link")).alias("state"))
    return parsed.select("nation", F.explode(links.layer_array(F.col("state"))).alias("l")).select("nation", F.col("l.name").alias("layer"), F.col("l.type").alias("type"))


@query("SELECT DISTINCT s_nationkey::BIGINT AS nation, 'seg' AS layer, 'segmentation' AS type FROM supplier")
def layer_by_pattern(spark, d):
    """The one layer of each state whose name starts with a match."""
    df = _states(spark, d).select("nation", links.one_layer(F.col("state"), "s[a-f]").alias("l"))
    return df.select("nation", F.col("l.name").alias("layer"), F.col("l.type").alias("type"))


@query("SELECT s_nationkey::BIGINT AS nation, count(*) AS layers FROM supplier GROUP BY 1")
def published_states(spark, d):
    """States published as files, one a row; how many annotation layers each file has."""
    at = _scratch(spark)
    publish.upload_states(_states(spark, d).withColumn("name", F.col("nation").cast("string")), at)
    files = spark.read.option("wholetext", True).text(f"{at}/*.json").select(F.regexp_extract(F.input_file_name(), r"(\d+)\.json$", 1).cast("long").alias("nation"), "value")
    return files.select("nation", F.size(F.filter(links.layer_array(F.col("value")), lambda x: x["type"] == "annotation")).cast("long").alias("layers"))


def _script(spark, d):
    """A link for each region, with a comment and a duration before it."""
    out = []
    for r in _t(spark, d, "region").orderBy("r_regionkey").collect():
        state = {"name": r.r_name, "layers": [{"key": int(r.r_regionkey), "p": [1, 2.5]}], **({"even": "yes"} if r.r_regionkey % 2 == 0 else {})}
        out += [f"# {r.r_name}", f"{r.r_regionkey + 0.5}", links.encode_link("https://v", state)]
    return "\n".join(out)


@query("SELECT r_regionkey::BIGINT AS region, r_name AS name, '# ' || r_name || chr(10) AS comment, r_regionkey + 0.5::DOUBLE AS duration, 3 * (r_regionkey + 1)::BIGINT AS line FROM region")
def script_items(spark, d):
    """Items of a video script."""
    items = video.read_script(_script(spark, d))
    return spark.createDataFrame([(x.state["layers"][0]["key"], x.state["name"], x.comment, x.duration, x.line) for x in items], "region long, name string, comment string, duration double, line long")


@query("SELECT r_regionkey::BIGINT AS region, 10::BIGINT AS lines, CASE WHEN r_regionkey % 2 = 0 THEN 0 ELSE 1 END::BIGINT AS gaps, r_name AS name FROM region")
def script_aligned(spark, d):
    """Aligned states: as many lines each, a gap for each key that a state lacks, and the state's JSON together."""
    items = video.align(video.read_script(_script(spark, d)))
    rows = []
    for x in items:
        again = json.loads("\n".join(x.aligned))
        rows.append((again["layers"][0]["key"], len(x.aligned), sum(not line for line in x.aligned), again["name"]))
    return spark.createDataFrame(rows, "region long, lines long, gaps long, name string")


@query("SELECT position::INT AS position, key FROM (VALUES (0, '{'), (1, 'name'), (2, 'layers.['), (3, 'layers.0.{'), (4, 'layers.0.key'), (5, 'layers.0.p'), (6, 'layers.0.}'), (7, 'layers.]'), (8, 'even'), (9, '}')) t(position, key) WHERE (SELECT count(*) FROM region) > 0")
def nested_state_keys(spark, d):
    """Merged keys of a script's states, in document order."""
    keys: list = []
    for i, x in enumerate(video.read_script(_script(spark, d))):
        keys = video.merge_keys(keys, video.nested_keys(x.state)) if i else video.nested_keys(x.state)
    return spark.createDataFrame([(i, ".".join(map(str, k))) for i, k in enumerate(keys)], "position int, key string")


@query("SELECT r_regionkey::BIGINT AS region, r_name AS name, r_regionkey + 0.5::DOUBLE AS duration FROM region WHERE r_regionkey > 0")
def script_sheet(spark, d):
    """A script to a sheet's tab-separated rows and back; the first duration is not kept there."""
    sheet = video.to_sheet(video.align(video.read_script(_script(spark, d))))
    items = video.read_script(video.from_sheet(sheet, "v"))[1:]
    return spark.createDataFrame([(x.state["layers"][0]["key"], x.state["name"], x.duration) for x in items], "region long, name string, duration double")


# ---- segment documents


@query(f"WITH {_SEG} SELECT segment::VARCHAR AS id, name FROM seg")
def seg_document_file(spark, d):
    """The document as it lies in its file."""
    at = _scratch(spark)
    _document(spark, d).write(at)
    doc = spark.read.option("wholetext", True).text(f"{at}/info")
    inline = doc.select(F.from_json("value", "inline struct<ids:array<string>,properties:array<struct<type:string,values:array<string>>>>")["inline"].alias("i"))
    label = F.filter("i.properties", lambda p: p["type"] == "label")[0]["values"]
    return inline.select(F.explode(F.arrays_zip(F.col("i.ids").alias("id"), label.alias("name"))).alias("r")).select("r.id", "r.name")


@query("SELECT col, type FROM (VALUES ('name', 'label'), ('size', 'number'), ('price', 'number')) t(col, type) WHERE (SELECT count(*) FROM part) > 0")
def seg_scalar_types(spark, d):
    """Which kind of property each column gives when none is named."""
    types = segprops.scalar_types(segments(spark, d).drop(*TAGS), "segment", "name", None, [], [])
    return spark.createDataFrame(sorted(types.items()), "col string, type string")


@query(f"WITH {_SEG} SELECT segment, 'brand:' || replace(brand, ' ', '_') AS tag FROM seg UNION ALL SELECT segment, 'is_large' FROM seg WHERE is_large")
def seg_tag_flags(spark, d):
    """A boolean column a tag (``consolidate=False``): the tags that are set."""
    info = segprops.segment_document(segments(spark, d), "name", tags=["brand", "is large"])
    flags = segprops.segment_table(spark, info, consolidate=False)
    tags = info.properties[-1]["tags"]
    pairs = F.array(*[F.when(F.col(f"`{t}`"), F.lit(t)) for t in tags])
    return flags.select("segment", F.explode(F.array_compact(pairs)).alias("tag"))


@query("SELECT DISTINCT 'brand:' || replace(p_brand, ' ', '_') AS tag, CASE WHEN p_brand = (SELECT min(p_brand) FROM part) THEN 'the first' ELSE 'brand:' || replace(p_brand, ' ', '_') END AS description FROM part")
def seg_tag_descriptions(spark, d):
    """Descriptions given for a tag's rest, else the tag itself."""
    first = _t(spark, d, "part").agg(F.min("p_brand")).first()[0]
    p = segprops.segment_document(segments(spark, d).drop("is large"), "name", tags=["brand"], tag_descriptions={first: "the first"}).properties[-1]
    return spark.createDataFrame(list(zip(p["tags"], p["tag_descriptions"])), "tag string, description string")


@query("SELECT * FROM (VALUES ('segment', true), ('brand twice', true), ('ok', false)) t(given, refused) WHERE (SELECT count(*) FROM part) > 0")
def seg_refused_arguments(spark, d):
    """Arguments that a document cannot have."""

    def refused(**given):
        try:
            segprops.segment_properties(segments(spark, d).drop("is large").limit(3), "name", **given)
        except ValueError:
            return True
        return False

    return spark.createDataFrame([("segment", refused(tags=["segment"])), ("brand twice", refused(tags=["brand", "brand"])), ("ok", refused(tags=["brand"]))], "given string, refused boolean")


@query(f"WITH {_SEG} SELECT segment, name AS label, size, replace(brand, ' ', '_') AS brand, size > 25 AS heavy FROM seg")
def seg_select_columns(spark, d):
    """Document to document with computed scalars and tags, all of its columns."""
    info = select.select_properties(spark, _document(spark, d), ["_default_tags", "size"], {"label": "{name}"}, {"heavy": "size > 25"})
    t = segprops.segment_table(spark, info)
    return t.select("segment", "label", "size", "brand", F.col("heavy").isNotNull().alias("heavy"))
