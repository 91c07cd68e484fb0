"""Exported values back to rows: the inverse of :mod:`annospark.operators.encode`, on Arrow batches.

Rows: a null value gives no row; a group without members gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def _floats(raw: np.ndarray, numbers: int) -> pa.Array:
    """Leading little-endian floats of each row of bytes, as lists."""
    values = np.ascontiguousarray(raw[:, : 4 * numbers]).view("<f4").ravel()
    return pa.FixedSizeListArray.from_arrays(pa.array(values, pa.float32()), numbers).cast(pa.list_(pa.float32()))


def _rest(raw: np.ndarray, numbers: int) -> pa.Array:
    data = np.ascontiguousarray(raw[:, 4 * numbers :])
    offsets = np.arange(len(data) + 1, dtype=np.int64) * data.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


#: Members of groups in one batch, about.
MOST_MEMBERS = 50_000
GROUP_SCHEMA = "seq long, id long, coords array<float>, rest binary"


def group_batches(items, record_size: int, numbers: int, keep: Sequence[tuple[str, pa.DataType]]):
    """Batches of ``keep, seq, id, coords, rest`` of (values of keep, group value or None): small groups together, large ones in parts."""
    own, n = [], 0

    def batch():
        counts = [len(ids) for *_, ids in own]
        which = np.repeat(np.arange(len(own)), counts)
        columns = [pa.array([k[i] for k, *_ in own], t).take(pa.array(which)) for i, (_, t) in enumerate(keep)]
        seq = np.concatenate([np.arange(first, first + c) for (_, first, _, _), c in zip(own, counts)])
        raw, ids = np.concatenate([r for _, _, r, _ in own]), np.concatenate([i for *_, i in own])
        return pa.RecordBatch.from_arrays([*columns, pa.array(seq), pa.array(ids), _floats(raw, numbers), _rest(raw, numbers)], [*[k for k, _ in keep], "seq", "id", "coords", "rest"])

    for key, data in items:
        members = int.from_bytes(data[:8], "little") if data else 0
        if not members:
            continue
        raw = np.frombuffer(data, np.uint8, members * record_size, 8).reshape(members, record_size)
        ids = np.frombuffer(data, "<i8", members, 8 + members * record_size)
        for s in range(0, members, MOST_MEMBERS):
            own.append((key, s, raw[s : s + MOST_MEMBERS], ids[s : s + MOST_MEMBERS]))
            n += len(own[-1][3])
            if n >= MOST_MEMBERS:
                yield batch()
                own, n = [], 0
    if own:
        yield batch()


def group_rows(values: DataFrame, record_size: int, numbers: int, keep: Sequence[str] = ("key",), value: str = "value") -> DataFrame:
    """``keep, seq, id, coords, rest`` of each member of group values with records of one size; coords are the first ``numbers`` floats."""
    kinds = {f.name: f.dataType for f in values.schema}
    types = [(k, to_arrow_type(kinds[k])) for k in keep]

    def run(batches):
        items = (((*k,), v.as_py()) for b in batches for *k, v in zip(*(c.to_pylist() for c in b.columns[: len(types)]), b.column(len(types))))
        yield from group_batches(items, record_size, numbers, types)

    return values.select(*keep, value).mapInArrow(run, "".join(f"{k} {kinds[k].simpleString()}, " for k in keep) + GROUP_SCHEMA)


def id_rows(values: DataFrame, record_size: int, numbers: int, relationships: int = 0, key: str = "key", value: str = "value") -> DataFrame:
    """``key, coords, rest, related`` of id values with records of one size; related has a list for each relationship."""

    def run(batches):
        for b in batches:
            data = [x or b"\0" * record_size for x in b.column(1).to_pylist()]
            raw = np.frombuffer(b"".join(x[:record_size] for x in data), np.uint8).reshape(-1, record_size)
            lists = []
            for x in data:
                at, own = record_size, []
                for _ in range(relationships):
                    n = int.from_bytes(x[at : at + 4], "little")
                    own.append(np.frombuffer(x, "<i8", n, at + 4).tolist())
                    at += 4 + 8 * n
                lists.append(own)
            yield pa.RecordBatch.from_arrays([b.column(0), _floats(raw, numbers), _rest(raw, numbers), pa.array(lists, pa.list_(pa.list_(pa.int64())))], [key, "coords", "rest", "related"])

    kind = values.schema[key].dataType.simpleString()
    return values.where(F.col(value).isNotNull()).select(key, value).mapInArrow(run, f"{key} {kind}, coords array<float>, rest binary, related array<array<bigint>>")


def polyline_rows(values: DataFrame, dimensions: int, key: str = "key", value: str = "value") -> DataFrame:
    """``key, vertices`` of polylines' id values: a list of coordinates for each vertex."""

    def run(batches):
        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                n = int.from_bytes(v[:4], "little")
                out.append(np.frombuffer(v, "<f4", n * dimensions, 4).reshape(n, dimensions).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.list_(pa.float32())))], [key, "vertices"])

    kind = values.schema[key].dataType.simpleString()
    return values.where(F.col(value).isNotNull()).select(key, value).mapInArrow(run, f"{key} {kind}, vertices array<array<float>>")
