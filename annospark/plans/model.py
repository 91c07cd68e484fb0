"""What the driver knows of an annotation table: coordinate space, geometry columns, properties, grids."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TYPES = ("point", "line", "axis_aligned_bounding_box", "ellipsoid", "polyline")
#: SI prefixes of the units that metadata gives in metres.
METRES = {"m": 1.0, "mm": 1e-3, "um": 1e-6, "µm": 1e-6, "nm": 1e-9, "pm": 1e-12}


@dataclass(frozen=True)
class CoordSpace:
    names: tuple[str, ...]
    units: tuple[str, ...]
    scales: tuple[float, ...]

    @staticmethod
    def of(space: CoordSpace | str | Sequence[str] | Mapping) -> CoordSpace:
        """From axis letters, axis names, ``{names, units, scales}``, or ``{axis: [scale, unit]}``."""
        if isinstance(space, CoordSpace):
            return space
        if isinstance(space, Mapping) and "names" not in space:
            return CoordSpace(tuple(space), tuple(u for _, u in space.values()), tuple(float(s) for s, _ in space.values()))
        if isinstance(space, Mapping):
            if unknown := space.keys() - {"names", "units", "scales", "coordinate_arrays"}:
                raise ValueError(f"unknown coordinate space keys {sorted(unknown)}")
            names, n = tuple(space["names"]), len(space["names"])
            units, scales = space.get("units", ["nm"] * n), space.get("scales", [1] * n)
            units = [units] * n if isinstance(units, str) else units
            return CoordSpace(names, tuple(units), tuple(map(float, scales)))
        if not isinstance(space, (str, list, tuple)) or not all(isinstance(a, str) and a == a.lower() for a in space):
            raise ValueError(f"invalid coordinate space {space!r}")
        if len(set(space)) != len(space) or not space:
            raise ValueError(f"axes of {space!r} are not unique")
        return CoordSpace(tuple(space), ("nm",) * len(space), (1.0,) * len(space))

    def to_json(self) -> dict:
        """Axis to [scale, unit], lengths in metres."""
        return {n: [s * METRES[u], "m"] if u in METRES else [s, u] for n, u, s in zip(self.names, self.units, self.scales)}


def geometry_columns(space: CoordSpace, kind: str) -> list[list[str]]:
    """Groups of coordinate columns of an annotation type, an axis after another."""
    names = space.names
    groups = {
        "point": [names],
        "line": [[f"{n}a" for n in names], [f"{n}b" for n in names]],
        "axis_aligned_bounding_box": [[f"{n}a" for n in names], [f"{n}b" for n in names]],
        "ellipsoid": [names, [f"r{n}" for n in names]],
        "polyline": [],
    }
    if kind not in groups:
        raise ValueError(f"unknown annotation type {kind!r}")
    return [list(g) for g in groups[kind]]


#: Bytes of each property type, and its rank in the record (higher ones first).
PROPERTY_TYPES = {"float32": (4, 4), "int32": (4, 4), "uint32": (4, 3), "int16": (2, 2), "uint16": (2, 2), "int8": (1, 1), "uint8": (1, 1), "rgb": (3, 1), "rgba": (4, 1)}


def _type_of(kind: T.DataType, name: str) -> str:
    if isinstance(kind, T.FloatType):
        return "float32"
    if isinstance(kind, T.ByteType):
        return "int8"
    if isinstance(kind, T.ShortType):
        return "int16"
    if isinstance(kind, T.IntegerType):
        return "int32"
    if isinstance(kind, (T.LongType, T.DoubleType, T.DecimalType)):
        raise ValueError(f"property {name}: 64-bit types are not supported, give a spec with a type")
    raise ValueError(f"property {name}: give enum_labels or a type for {kind.simpleString()}")


def property_specs(df: DataFrame, properties: Sequence[str | Mapping] | Mapping[str, Mapping] | str) -> list[dict]:
    """Specs in record order.  What a spec leaves out comes from the schema; string columns need ``enum_labels`` or a colour type.

    ``enum_labels`` in a column's metadata (see ``sources.tables``) are used too.
    """
    if isinstance(properties, str):
        properties = [properties]
    given = {k: dict(v) for k, v in properties.items()} if isinstance(properties, Mapping) else {p if isinstance(p, str) else p["id"]: {} if isinstance(p, str) else dict(p) for p in properties}
    columns, specs = {f.name: f for f in df.schema}, []
    for name, own in given.items():
        spec = {"id": name}
        channels = lambda letters: all(f"{name}_{c}" in columns for c in letters)
        if name in columns:
            labels = own.get("enum_labels") or columns[name].metadata.get("enum_labels")
            if labels:
                spec |= {"type": "uint8" if len(labels) <= 256 else "uint16", "enum_values": list(range(len(labels))), "enum_labels": list(labels)}
            elif "type" not in own:
                spec["type"] = columns[name].metadata.get("property_type") or _type_of(columns[name].dataType, name)
        elif channels("rgba"):
            spec["type"] = "rgba"
        elif channels("rgb"):
            spec["type"] = "rgb"
        else:
            raise ValueError(f"property {name!r} is not a column")
        specs.append(spec | own)
    for s in specs:
        if s["type"] not in PROPERTY_TYPES:
            raise ValueError(f"unknown property type {s['type']!r}")
        if not re.fullmatch(r"[a-z][a-zA-Z0-9_]*", s["id"]):
            raise ValueError(f"invalid property name {s['id']!r}")
    return sorted(specs, key=lambda s: -PROPERTY_TYPES[s["type"]][1])


def property_columns(df: DataFrame, specs: Sequence[Mapping]) -> list[str]:
    out = []
    for s in specs:
        whole = s["type"] not in ("rgb", "rgba") or s["id"] in df.columns
        out += [s["id"]] if whole else [f"{s['id']}_{c}" for c in s["type"]]
    return out


def record_size(specs: Sequence[Mapping], geometry_values: int) -> int:
    """Bytes of a record without vertices: geometry, properties, padding of the properties to 4 bytes."""
    n = sum(PROPERTY_TYPES[s["type"]][0] for s in specs)
    return 4 * geometry_values + -(-n // 4) * 4


@dataclass(frozen=True)
class Grid:
    """One level: cell sizes (rounded to float32) and cells an axis."""

    chunk: tuple[float, ...]
    shape: tuple[int, ...]


def spatial_grids(lower: Sequence[float], upper: Sequence[float], scales: Sequence[float], levels: int) -> list[Grid]:
    """Each level halves the widest axis, and others while that brings cells nearer to cubes; an axis without extent stays one cell."""
    if not 1 <= levels <= 64:
        raise ValueError("there must be 1 to 64 levels")
    width = [(b - a) * s for a, b, s in zip(lower, upper, scales)]
    shape, out = [1] * len(width), []
    for _ in range(levels):
        out.append(Grid(tuple(float(np.float32(w / s)) for w, s in zip(width, scales)), tuple(shape)))
        widest = max(range(len(width)), key=lambda d: (width[d], -d))
        target = width[widest] / 2
        if target <= 0:
            continue
        for d in range(len(width)):
            if d == widest or width[d] / target > 1.5:
                width[d] /= 2
                shape[d] *= 2
    return out


def quotas(count: int, grids: Sequence[Grid], target: int) -> list[int]:
    """Annotations of each level: ``target`` a cell while they last, the last level takes the rest; 0: all in one level."""
    if target == 0:
        if len(grids) > 1:
            raise ValueError("without a target there can be only one level")
        return [count]
    out, left = [], count
    for i, g in enumerate(grids):
        n = left if i == len(grids) - 1 else min(left, target * int(np.prod([int(x) for x in g.shape], dtype=object)))
        out.append(n)
        left -= n
    return out
