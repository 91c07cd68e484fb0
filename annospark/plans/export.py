"""Export of an annotation table: id index, related-segment indexes, multi-level spatial index, and ``info``.

One aggregate validates the table and gives bounds and counts.  Levels come
from exact quotas, cells from generators; records are packed before the one
shuffle that brings each shard's rows together.  Indexes are written to a
directory of their own and take the place of older ones when all are there;
``info`` comes last, so an export that fails leaves an older one as it was.
"""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annospark.functions.bits import unsigned, unsigned_order, unsigned_text
from annospark.functions.shardhash import choose_spec
from annospark.operators.bounds import Summary, summarize
from annospark.operators.cells import assign_cells, chunk_limits, dropped_polylines, with_vertices
from annospark.operators.encode import encode_records, group_frame, needed_columns
from annospark.operators.levels import shuffled_key, with_level
from annospark.operators.relationships import as_list, pairs
from annospark.plans.model import CoordSpace, Grid, geometry_columns, property_specs, quotas, record_size, spatial_grids
from annospark.sources.shards import make_dir, put_file, remove_dir, replace_dir, write_files, write_sharded

INFO_TYPE = "neuroglancer_annotations_v1"  # fixed value of the format


def prepare(df: DataFrame | None, space: CoordSpace, kind: str, specs: Sequence[Mapping], relationships: Sequence[str], polyline_points: DataFrame | None, id_col: str, vertex_order: str, keep: Sequence[str] = ()) -> DataFrame:
    """The columns that the export needs, with vertices for polylines."""
    if kind == "polyline":
        if polyline_points is None:
            raise ValueError("polylines need polyline_points")
        if df is not None:
            gone = dropped_polylines(df, polyline_points, id_col).first()
            if gone.polylines or gone.vertex_groups:
                warnings.warn(f"{gone.polylines} polylines have no vertices and {gone.vertex_groups} groups of vertices no polyline; they are dropped", stacklevel=3)
        df = with_vertices(df, polyline_points, space, id_col, vertex_order)
    elif df is None or polyline_points is not None:
        raise ValueError("a table, and polyline_points for polylines alone, must be given")
    missing = [c for g in geometry_columns(space, kind) for c in g if c not in df.columns] + [r for r in relationships if r not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.select(*dict.fromkeys([id_col, *needed_columns(df, space, kind, specs), *relationships, *keep]))


def spatial_assignment(df: DataFrame, space: CoordSpace, kind: str, summary: Summary, levels: int = 64, target: int = 10_000, shuffle: bool = True, seed: int = 0, order_col: str | None = None, id_col: str = "annotation_id", compat: bool = False) -> tuple[DataFrame, list[Grid], list[int]]:
    """Rows by level and cell (see :func:`assign_cells`), the grids and the quotas of the levels in use."""
    grids = spatial_grids(summary.lower, summary.upper, space.scales, levels)
    sizes = quotas(summary.count, grids, target)
    used = max(i for i, n in enumerate(sizes) if n) + 1
    grids, sizes = grids[:used], sizes[:used]
    key = shuffled_key(id_col, seed) if shuffle else F.col(order_col).cast("long") if order_col else unsigned_order(F.col(id_col))
    leveled = with_level(df, sizes, key, id_col)
    return assign_cells(leveled, space, kind, grids, summary.lower, compat=compat), grids, sizes


def export_annotations(
    df: DataFrame | None, coord_space, annotation_type: str, properties=(), relationships: Sequence[str] = (), output_dir: str = "annotations", sharded: bool = True, *,
    polyline_points: DataFrame | None = None, write_by_id: bool = True, write_by_relationship: bool = True, write_by_spatial_chunk: bool = True,
    num_spatial_levels: int = 64, target_chunk_limit: int = 10_000, shuffle_spatial_ordering: bool = True, order_col: str | None = None,
    id_col: str = "annotation_id", vertex_order: str = "vertex", seed: int = 0, description: str = "", compat: bool = False,
) -> dict:
    """Writes all indexes under ``output_dir`` and returns ``info``."""
    kind = annotation_type.lower()
    space = CoordSpace.of(coord_space)
    geometry_columns(space, kind)
    if isinstance(relationships, str):
        relationships = [relationships]
    specs = property_specs(df, properties) if df is not None else []
    df = prepare(df, space, kind, specs, relationships, polyline_points, id_col, vertex_order, [order_col] if order_col else [])
    summary = summarize(df, space, kind, id_col)
    values = sum(len(g) for g in geometry_columns(space, kind))
    size = record_size(specs, values)
    vertex_bytes = (4 + 4 * len(space.names) * F.size("vertices")) if kind == "polyline" else F.lit(0)
    tail = f"0{len(str(64))}d"
    staged, keys = f"{output_dir.rstrip('/')}/.staged-{uuid.uuid4().hex[:12]}", []

    def index(key: str) -> str:
        keys.append(key)
        make_dir(f"{staged}/{key}")
        return f"{staged}/{key}"

    info = {"@type": INFO_TYPE, "dimensions": space.to_json(), "lower_bound": list(summary.lower), "upper_bound": list(summary.upper), "annotation_type": kind, "properties": specs, "by_id": {}, "relationships": [], "spatial": []}

    if write_by_id:
        at = index("by_id")
        rows = encode_records(df, space, kind, specs, [id_col], relationships)
        info["by_id"] = {"key": "by_id"}
        if sharded:
            extra = sum((4 + 8 * F.size(as_list(df, r)) for r in relationships), vertex_bytes)
            total = df.agg(F.sum((F.lit(size) + extra).cast("long"))).first()[0]
            spec = choose_spec(summary.count, total, summary.max_id)
            write_sharded(rows.select(F.lit(0).cast("long").alias("grp"), F.col(id_col).alias("key"), F.col(id_col).alias("id"), "record"), {0: spec}, {0: at}, grouped=False, keys_of={0: summary.count})
            info["by_id"]["sharding"] = spec.to_json()
        else:
            write_files(rows.select(F.concat(F.lit(f"{at}/"), unsigned_text(F.col(id_col))).alias("name"), F.col("record").alias("value")))

    if write_by_relationship and relationships:
        own = needed_columns(df, space, kind, specs)
        parts, spec_of, dir_of, keys_of, members = None, {}, {}, {}, 0
        for i, r in enumerate(relationships):
            at = index(f"by_rel_{r}")
            p = pairs(df, r, *dict.fromkeys([id_col, *own])).withColumn("grp", F.lit(i).cast("long"))
            entry = {"id": r, "key": f"by_rel_{r}"}
            if sharded:
                n, total, most, own_members = p.groupBy("segment").agg(F.sum((F.lit(size + 8) + vertex_bytes).cast("long")).alias("b"), F.count(F.lit(1)).alias("m")).agg(F.count(F.lit(1)), F.sum("b"), F.max(unsigned_order(F.col("segment"))), F.sum("m")).first()
                if n:
                    spec_of[i], dir_of[i] = choose_spec(n, total + 8 * n, unsigned(most ^ -(1 << 63))), at
                    keys_of[i] = n
                    members += own_members
                    entry["sharding"] = spec_of[i].to_json()
            info["relationships"].append(entry)
            parts = p if parts is None else parts.unionByName(p)
        rows = encode_records(parts, space, kind, specs, ["grp", "segment", id_col])
        if sharded:
            rows = rows.select("grp", F.col("segment").alias("key"), F.col(id_col).alias("id"), "record", unsigned_order(F.col(id_col)).alias("seq"))
            write_sharded(rows, spec_of, dir_of, grouped=True, order=["seq"], keys_of=keys_of, count=members)
        else:
            groups = group_frame(rows.withColumn("seq", unsigned_order(F.col(id_col))), ["grp", "segment"], ["seq"], id_col)
            name = F.element_at(F.lit([f"{staged}/by_rel_{r}/" for r in relationships]), F.col("grp").cast("int") + 1)
            write_files(groups.select(F.concat(name, unsigned_text(F.col("segment"))).alias("name"), "value"))

    if write_by_spatial_chunk:
        assigned, grids, sizes = spatial_assignment(df, space, kind, summary, num_spatial_levels, target_chunk_limit, shuffle_spatial_ordering, seed, order_col, id_col, compat)
        cell_cols = [f"cell_{n}" for n in space.names]
        stats = {r.level: r for r in assigned.groupBy("level", "code").agg(F.count(F.lit(1)).alias("n"), F.sum((F.lit(size + 8) + vertex_bytes).cast("long")).alias("b")).groupBy("level").agg(F.count(F.lit(1)).alias("chunks"), F.max("n").alias("limit"), F.sum("n").alias("members"), F.sum("b").alias("bytes"), F.max("code").alias("top")).collect()}
        seq = F.xxhash64(F.col(id_col), F.lit(seed + 1)) if shuffle_spatial_ordering else F.col(order_col).cast("long") if order_col else unsigned_order(F.col(id_col))
        rows = encode_records(assigned.withColumn("seq", seq), space, kind, specs, ["level", "code", *cell_cols, id_col, "seq"])
        spec_of, dir_of = {}, {}
        for level in sorted(stats):
            s, key = stats[level], f"by_spatial_level_{level:{tail}}"
            at = index(key)
            entry = {"key": key}
            if sharded:
                spec_of[level], dir_of[level] = choose_spec(s.chunks, s.bytes + 8 * s.chunks, s.top), at
                entry["sharding"] = spec_of[level].to_json()
            entry |= {"chunk_size": list(grids[level].chunk), "grid_shape": list(grids[level].shape), "limit": 1 if target_chunk_limit == 0 else s.limit}
            info["spatial"].append(entry)
        if sharded:
            write_sharded(rows.select(F.col("level").cast("long").alias("grp"), F.col("code").alias("key"), F.col(id_col).alias("id"), "record", "seq"), spec_of, dir_of, grouped=True, order=["seq", "id"], keys_of={level: s.chunks for level, s in stats.items()}, count=sum(s.members for s in stats.values()))
        else:
            groups = group_frame(rows, ["level", "code", *cell_cols], ["seq", id_col], id_col)
            name = F.concat(F.lit(f"{staged}/by_spatial_level_"), F.lpad(F.col("level").cast("string"), len(str(64)), "0"), F.lit("/"), F.concat_ws("_", *cell_cols))
            write_files(groups.select(name.alias("name"), "value"))

    if description:
        info["description"] = description
    for key in keys:
        replace_dir(f"{staged}/{key}", f"{output_dir.rstrip('/')}/{key}")
    remove_dir(staged)
    put_file(f"{output_dir}/info", json.dumps(info).encode())
    return info


__all__ = ["chunk_limits", "export_annotations", "prepare", "spatial_assignment"]
