"""Little-endian binary records of annotations, packed with numpy on Arrow batches.

record:      coordinates as float32 (polylines: uint32 count first), properties
             in record order, zero padding of the properties to 4 bytes
by-id value: record, then for each relationship uint32 count and uint64 ids
group value: uint64 count, the records, the uint64 ids
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from annospark.operators.relationships import as_list
from annospark.plans.model import PROPERTY_TYPES, CoordSpace, geometry_columns, property_columns


def _fields(df_columns: Sequence[str], specs: Sequence[Mapping]) -> list[tuple[str, str, str, Mapping]]:
    """(column, field, numpy type, spec) of each stored number."""
    out = []
    for s in specs:
        if s["type"] in ("rgb", "rgba"):
            out += [(s["id"] if s["id"] in df_columns else f"{s['id']}_{c}", f"{s['id']}_{c}", "<u1", s) for c in s["type"]]
        else:
            out.append((s["id"], s["id"], np.dtype(s["type"]).newbyteorder("<").str, s))
    return out


def _numbers(column: pa.Array, field: str, kind: str, spec: Mapping) -> np.ndarray:
    if column.null_count:
        raise ValueError(f"property {spec['id']} has null values")
    if spec.get("enum_labels") and pa.types.is_string(column.type):
        codes = pa.compute.index_in(column, pa.array(spec["enum_labels"], pa.string()))
        if codes.null_count:
            raise ValueError(f"property {spec['id']} has values that are none of its labels")
        values = codes.to_numpy()
        if spec.get("enum_values"):
            values = np.asarray(spec["enum_values"])[values]
    elif spec["type"] in ("rgb", "rgba") and pa.types.is_string(column.type):
        at = 1 + 2 * "rgba".index(field[-1])
        values = np.array([int(x[at : at + 2], 16) for x in column.to_pylist()])
    else:
        values = column.to_numpy(zero_copy_only=False)
    if np.dtype(kind).kind in "iu" and len(values):
        limits = np.iinfo(kind)
        if values.min() < limits.min or values.max() > limits.max:
            raise ValueError(f"property {spec['id']} has values outside {spec['type']}")
    return values


def record_packer(space: CoordSpace, kind: str, specs: Sequence[Mapping], columns: Sequence[str]) -> Callable[[pa.RecordBatch], list[bytes]]:
    coords = [c for g in geometry_columns(space, kind) for c in g]
    fields = _fields(columns, specs)
    size = sum(PROPERTY_TYPES[s["type"]][0] for s in specs)
    layout = np.dtype([(f"g{i}", "<f4") for i in range(len(coords))] + [(f"p{i}", k) for i, (_, _, k, _) in enumerate(fields)] + ([("pad", f"V{-size % 4}")] if size % 4 else []))

    def pack(b: pa.RecordBatch) -> list[bytes]:
        rows = np.zeros(b.num_rows, dtype=layout)
        for i, c in enumerate(coords):
            rows[f"g{i}"] = b.column(c).to_numpy(zero_copy_only=False)
        for i, (column, field, k, spec) in enumerate(fields):
            rows[f"p{i}"] = _numbers(b.column(column), field, k, spec)
        raw, n = rows.tobytes(), layout.itemsize
        fixed = [raw[i * n : i * n + n] for i in range(b.num_rows)]
        if kind != "polyline":
            return fixed
        v = b.column("vertices")
        at, points = v.offsets.to_numpy().tolist(), v.values
        raw = np.stack([points.field(a).to_numpy(zero_copy_only=False) for a in space.names], 1).astype("<f4").tobytes()
        width = 4 * len(space.names)
        return [struct.pack("<I", e - s) + raw[s * width : e * width] + rest for s, e, rest in zip(at, at[1:], fixed)]

    return pack


def needed_columns(df: DataFrame, space: CoordSpace, kind: str, specs: Sequence[Mapping]) -> list[str]:
    return [c for g in geometry_columns(space, kind) for c in g] + property_columns(df, specs) + (["vertices"] if kind == "polyline" else [])


def encode_records(df: DataFrame, space: CoordSpace, kind: str, specs: Sequence[Mapping], keep: Sequence[str], relationships: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns and ``record``, with the relationships' lists in it if any are named."""
    cols = list(dict.fromkeys(needed_columns(df, space, kind, specs)))
    lists = [as_list(df, r).alias(f"__r{i}") for i, r in enumerate(relationships)]
    src = df.select(*[F.col(c).alias(f"__keep_{c}") for c in keep], *cols, *lists)
    pack = record_packer(space, kind, specs, cols)

    def run(batches):
        for b in batches:
            records = pack(b)
            for i in range(len(relationships)):
                lists = b.column(f"__r{i}")
                at, raw = lists.offsets.to_numpy().tolist(), lists.values.to_numpy(zero_copy_only=False).astype("<i8").tobytes()
                records = [r + struct.pack("<I", e - s) + raw[8 * s : 8 * e] for r, s, e in zip(records, at, at[1:])]
            yield pa.RecordBatch.from_arrays([*[b.column(f"__keep_{c}") for c in keep], pa.array(records, pa.binary())], [*keep, "record"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return src.mapInArrow(run, "".join(f"{c} {kinds[c]}, " for c in keep) + "record binary")


def joined_runs(batches, keys: int):
    """(key, members, their records joined, their ids joined) of successive rows with equal first ``keys`` columns; id and record follow these.

    A run's records lie side by side in an Arrow batch and are taken as one
    slice; one run is held beyond a batch.
    """
    at, n, records, ids = None, 0, [], []
    for b in batches:
        if not b.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in b.columns[:keys]]
        edges = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1).tolist(), b.num_rows]
        column = b.column(keys + 1)
        kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        offsets = np.frombuffer(column.buffers()[1], kind, b.num_rows + 1, column.offset * np.dtype(kind).itemsize).tolist()
        data, own = memoryview(column.buffers()[2] or b""), b.column(keys).to_numpy()
        for s, e, key in zip(edges, edges[1:], zip(*(c[edges[:-1]].tolist() for c in columns))):
            if key != at:
                if n:
                    yield at, n, b"".join(records), b"".join(ids)
                at, n, records, ids = key, 0, [], []
            n += e - s
            records.append(bytes(data[offsets[s] : offsets[e]]))
            ids.append(own[s:e].astype("<i8").tobytes())
    if n:
        yield at, n, b"".join(records), b"".join(ids)


def group_value(n: int, records: bytes, ids: bytes) -> bytes:
    return struct.pack("<Q", n) + records + ids


def unpack_group(value: bytes, record_size: int) -> tuple[list[bytes], list[int]]:
    """Records of fixed size and unsigned ids of a group value."""
    (n,) = struct.unpack_from("<Q", value)
    ids = np.frombuffer(value, dtype="<u8", offset=8 + n * record_size, count=n)
    return [value[8 + i * record_size : 8 + (i + 1) * record_size] for i in range(n)], [int(x) for x in ids]


def group_frame(records: DataFrame, keys: Sequence[str], order: Sequence[str], id_col: str = "annotation_id") -> DataFrame:
    """``keys, n, value``: group values, members in order of ``order``.

    A value is one file entry and so one row by its format; rows reach it
    sorted, in a stream of batches, so no more than a value is held at once.
    """
    src = records.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, F.col(id_col).alias("__id"), "record")
    kinds = {f.name: f.dataType for f in src.schema}

    def run(batches):
        for key, n, recs, ids in joined_runs(batches, len(keys)):
            yield pa.RecordBatch.from_arrays([*[pa.array([k]) for k in key], pa.array([n], pa.int64()), pa.array([group_value(n, recs, ids)], pa.binary())], [*keys, "n", "value"]).cast(schema)

    schema = pa.schema([*[(k, to_arrow_type(kinds[k])) for k in keys], ("n", pa.int64()), ("value", pa.binary())])
    return src.mapInArrow(run, "".join(f"{k} {kinds[k].simpleString()}, " for k in keys) + "n long, value binary")
