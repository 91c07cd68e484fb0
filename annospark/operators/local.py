"""Local annotation layers: viewer states to flat tables and back."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annospark.plans.model import property_specs
from annospark.sources.links import parse_link

COORDS = ["x", "y", "z", "rx", "ry", "rz", "xa", "ya", "za", "xb", "yb", "zb"]
ORDER = ["link_index", "user", "layer", "type", *COORDS, "id", "description"]
_POINTS = {"point": ["x", "y", "z"], "radii": ["rx", "ry", "rz"], "pointA": ["xa", "ya", "za"], "pointB": ["xb", "yb", "zb"]}
_STATE = "struct<layers:array<struct<type:string,name:string,archived:boolean,visible:boolean,annotations:array<struct<type:string,id:string,description:string,point:array<double>,radii:array<double>,pointA:array<double>,pointB:array<double>>>>>>"


def extract_states(states: DataFrame, state_col: str = "state", visible_only: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """A row for each annotation of the annotation layers of JSON states: ``keep``, layer, type, coordinates, id, description.

    A distributed form of :func:`extract_annotations`: any number of states.
    """
    layers = states.select(*keep, F.explode(F.from_json(state_col, _STATE)["layers"]).alias("l")).where(F.col("l.type") == "annotation")
    if visible_only:
        layers = layers.where(~F.coalesce("l.archived", F.lit(False)) & F.coalesce("l.visible", F.lit(True)))
    rows = layers.select(*keep, F.col("l.name").alias("layer"), F.explode("l.annotations").alias("a"))
    coords = {c: F.try_element_at(F.col(f"a.{k}"), F.lit(i + 1)) for k, cs in _POINTS.items() for i, c in enumerate(cs)}
    return rows.select(*keep, "layer", F.col("a.type").alias("type"), *[coords[c].alias(c) for c in COORDS], F.col("a.id").alias("id"), F.col("a.description").alias("description"))


def narrow_coordinates(df: DataFrame) -> DataFrame:
    """Drops coordinate columns without a value; those that are whole numbers in every row become longs."""
    r = df.agg(*[F.count(c).alias(f"n_{c}") for c in COORDS], *[F.bool_and(F.col(c).isNotNull() & (F.col(c) % 1 == 0)).alias(f"w_{c}") for c in COORDS]).first()
    return df.select(*[F.col(c).cast("long").alias(c) if c in COORDS and r[f"w_{c}"] else F.col(c) for c in df.columns if c not in COORDS or r[f"n_{c}"]])


def extract_annotations(spark: SparkSession, link, *, link_index: int | None = None, user: str | None = None, visible_only: bool = False) -> DataFrame:
    """The annotations of a link or state; columns that no annotation has are left out."""
    state = parse_link(link) if isinstance(link, str) else link
    df = extract_states(spark.createDataFrame([(json.dumps(state),)], "state string"), "state", visible_only)
    some = {k for layer in state["layers"] if layer.get("type") == "annotation" for a in layer.get("annotations") or [] for k in a}
    df = narrow_coordinates(df).drop(*{"id", "description"} - some)
    if link_index is not None:
        df = df.withColumn("link_index", F.lit(link_index))
    if user is not None:
        df = df.withColumn("user", F.lit(user))
    return df.select(*[c for c in ORDER if c in df.columns])


def standardize(df: DataFrame) -> DataFrame:
    """All geometry columns, an id (given, else a hash of the geometry) and a type (given, else inferred) for every row.

    A row must have x, y, z or both end points, not both kinds: else the query fails.
    """
    for c in [*COORDS, "type"]:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string" if c == "type" else "double"))
    filled = lambda cs: F.forall(F.array(*[F.col(c).cast("double") for c in cs]), lambda v: v.isNotNull() & ~F.isnan(v))
    one, two = filled(COORDS[:3]), filled(COORDS[6:])
    message = F.lit("every row needs either x, y, z or xa, ya, za, xb, yb, zb, and not both")
    geometry = F.when(one & ~filled(["rx", "ry", "rz"]), F.lit("point")).when(one, F.lit("ellipsoid")).when(two, F.lit("axis_aligned_bounding_box"))
    kind = F.when(one == two, F.raise_error(message).cast("string")).otherwise(F.coalesce("type", geometry))
    id_ = F.col("id").cast("string") if "id" in df.columns else F.concat(F.lit("0x"), F.lower(F.hex(F.xxhash64(*[F.col(c).cast("double") for c in COORDS], "type"))))
    return df.withColumn("type", kind).withColumn("id", id_)


#: The viewer's shader functions, and the arguments at which a layer looks as it does by default.
SHADER_PARTS = {
    "point": ("Points", ["setPointMarkerSize({size})", "setPointMarkerColor(vec4(defaultColor(), 1.0))", "setPointMarkerBorderWidth(1.0)", "setPointMarkerBorderColor(defaultColor())"]),
    "line": ("Lines", ["setLineColor(defaultColor())", "setEndpointMarkerSize({size}, {size})", "setEndpointMarkerColor(defaultColor(), defaultColor())", "setEndpointMarkerBorderWidth(1.0, 1.0)", "setEndpointMarkerBorderColor(defaultColor(), defaultColor())"]),
    "axis_aligned_bounding_box": ("Boxes", ["setBoundingBoxBorderWidth(1.0)", "setBoundingBoxBorderColor(defaultColor())", "setBoundingBoxFillColor(vec4(defaultColor(), 0.5))"]),
    "ellipsoid": ("Ellipsoids", ["setEllipsoidFillColor(defaultColor())"]),
}


def default_shader(types: Sequence[str], size: float = 8.0) -> str:
    """A shader that calls the viewer's functions for each type with their defaults."""
    lines = [f"  {line}" for t, (title, calls) in SHADER_PARTS.items() if t in types for line in [f"// {title}", *[f"{c.format(size=size)};" for c in calls]]]
    return "\n".join(["void main() {", *lines, "}", ""])


def annotation_json(df: DataFrame, linked_layer: str | None = None, properties: Sequence[str] = ()) -> DataFrame:
    """``id, json``: an annotation's JSON, built in the engine."""
    d = lambda cs: F.array(*[F.col(c).cast("double") for c in cs])
    kind = F.col("type")
    ok = ("point", "line", "axis_aligned_bounding_box", "ellipsoid")
    fields = [F.when(kind.isin(*ok), kind).otherwise(F.raise_error(F.concat(F.lit("invalid annotation type "), kind)).cast("string")).alias("type"), F.col("id")]
    if "description" in df.columns:
        fields.append(F.col("description"))
    fields += [
        F.when(kind.isin("point", "ellipsoid"), d(COORDS[:3])).alias("point"), F.when(kind == "ellipsoid", d(COORDS[3:6])).alias("radii"),
        F.when(kind.isin(*ok[1:3]), d(COORDS[6:9])).alias("pointA"), F.when(kind.isin(*ok[1:3]), d(COORDS[9:])).alias("pointB"),
    ]
    if linked_layer and "segments" in df.columns:
        many = isinstance(df.schema["segments"].dataType, T.ArrayType)
        fields.append((F.col("segments") if many else F.array("segments")).cast("array<bigint>").cast("array<string>").alias("segments"))
    if properties:
        fields.append(F.concat(F.lit("["), F.concat_ws(",", *[F.regexp_extract(F.to_json(F.struct(F.col(p).alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":(.*)\}$', 1) for p in properties]), F.lit("]")).alias("props"))
    out = F.to_json(F.struct(*[f for f in fields]))
    if properties:  # props is JSON itself
        out = F.concat(F.expr("left(j, length(j) - 1)"), F.lit(',"props":'), F.col("props"), F.lit("}"))
        return df.select("id", F.to_json(F.struct(*fields[:-1])).alias("j"), fields[-1]).select("id", out.alias("json"))
    return df.select("id", out.alias("json"))


def local_layer(df: DataFrame, name: str = "annotations", color: str = "#ffff00", size: float = 8.0, linked_layer: str | None = None, show_panel: bool = False, properties: Sequence | Mapping | str = (), shader: str | None = None, res_nm_xyz: Sequence[float] = (8, 8, 8), order_col: str | None = None) -> dict:
    """A layer's JSON: one document, so its annotations are collected in the end."""
    df = standardize(df)
    specs = []
    colors = {p: "rgb" for p in ([properties] if isinstance(properties, str) else properties) if isinstance(p, str) and p in df.columns and isinstance(df.schema[p].dataType, T.StringType) and not df.schema[p].metadata.get("enum_labels")}
    if colors:
        r = df.agg(*[F.max(F.length(p)).alias(p) for p in colors]).first()
        colors = {p: "rgba" if r[p] == 9 else "rgb" for p in colors}
    if properties:
        given = properties if isinstance(properties, Mapping) else [{"id": p, "type": colors[p]} if p in colors else p for p in ([properties] if isinstance(properties, str) else properties)]
        specs = property_specs(df, given)
    names = [s["id"] for s in specs]
    for s in specs:
        if s.get("enum_labels") and isinstance(df.schema[s["id"]].dataType, T.StringType):
            df = df.withColumn(s["id"], F.array_position(F.lit(s["enum_labels"]), F.col(s["id"])).cast("int") - 1)
    layer = {
        "type": "annotation", "name": name,
        "source": {"url": "local://annotations", "transform": {"outputDimensions": {a: [r * 1e-9, "m"] for a, r in zip("xyz", res_nm_xyz)}}},
        "tool": "annotatePoint", "tab": "annotations", "annotationColor": color,
        "shader": shader or default_shader([r.type for r in df.select("type").distinct().collect()], size),
    }
    if show_panel:
        layer["panels"] = [{"row": 1, "flex": 1.22, "tab": "annotations"}]
    if linked_layer:
        layer |= {"linkedSegmentationLayer": linked_layer, "filterBySegmentation": ["segments"]}
    if specs:
        layer["annotationProperties"] = specs
    rows = annotation_json(df, linked_layer, names) if not order_col else annotation_json(df.orderBy(order_col), linked_layer, names)
    layer["annotations"] = [json.loads(r.json) for r in rows.collect()]
    return layer
