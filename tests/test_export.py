"""Exports read back from their files."""

import json
import os
import struct

import numpy as np
import pandas as pd
import pytest
from annospark.functions.bits import signed, unsigned
from annospark.functions.shardhash import ShardSpec
from annospark.operators.encode import unpack_group
from annospark.plans.export import export_annotations
from annospark.plans.file_queries import export_spatial_shuffled
from annospark.plans.model import CoordSpace, property_specs
from annospark.sources.shards import get_file, pack_shard, read_files, read_sharded, unpack_shard
from annospark.sources.tables import from_arrow, from_feather, from_pandas, from_parquet, read_annotations


def spec_of(j):
    return ShardSpec(j["preshift_bits"], j["shard_bits"], j["minishard_bits"], j["hash"], j["data_encoding"], j["minishard_index_encoding"])


def index(spark, info, at, part):
    path = f"{at}/{part['key']}"
    if "sharding" in part:
        return {unsigned(r.key): bytes(r.value) for r in read_sharded(spark, path, spec_of(part["sharding"])).collect()}
    return {r.name: bytes(r.value) for r in read_files(spark, path).collect()} if os.listdir(path) else {}


def test_list_relationship(spark, tmp_path):
    rows = [(10, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, [100, 200]), (20, 1.0, 1.0, 1.0, 2.0, 2.0, 3.0, [100, 100, 300]), (30, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0, [])]
    df = spark.createDataFrame(rows, "annotation_id long, xa double, ya double, za double, xb double, yb double, zb double, near array<long>")
    at = str(tmp_path)
    info = export_annotations(df, "xyz", "line", relationships=["near"], output_dir=at)
    assert json.loads(get_file(f"{at}/info")) == json.loads(json.dumps(info))
    got = {k: unpack_group(v, 24)[1] for k, v in index(spark, info, at, info["relationships"][0]).items()}
    assert got == {100: [10, 20], 200: [10], 300: [20]}
    by_id = index(spark, info, at, info["by_id"])
    assert struct.unpack("<6fI3Q", by_id[20]) == (1, 1, 1, 2, 2, 3, 3, 100, 100, 300)  # repeats stay here
    assert struct.unpack("<6fI", by_id[30])[-1] == 0


@pytest.mark.parametrize("sharded", [True, False])
def test_points(spark, tmp_path, sharded):
    n = 500
    rng = np.random.RandomState(0)
    ids = rng.permutation(10**6)[:n].astype(np.uint64) + np.uint64(1 << 63)
    pdf = pd.DataFrame({"x": rng.rand(n), "y": rng.rand(n) * 2, "z": rng.rand(n), "kind": pd.Categorical(rng.choice(["b", "a", "c"], n), ["c", "b", "a"]), "score": rng.rand(n).astype("f4"), "tone_r": 1, "tone_g": 2, "tone_b": 255, "body": rng.randint(1, 9, n).astype(np.uint64)}, index=pd.Index(ids, name="annotation_id"))
    at = str(tmp_path)
    info = export_annotations(from_pandas(spark, pdf), {"names": list("xyz"), "units": "nm", "scales": [8, 8, 8]}, "point", ["kind", "score", "tone"], ["body"], at, sharded, num_spatial_levels=4, target_chunk_limit=20, description="d")
    assert [p["id"] for p in info["properties"]] == ["score", "kind", "tone"]
    assert info["properties"][1]["enum_labels"] == ["c", "b", "a"] and info["properties"][1]["type"] == "uint8"
    size = 12 + 8
    by_id = index(spark, info, at, info["by_id"])
    assert len(by_id) == n
    for i, row in pdf.head(20).iterrows():
        v = by_id[int(i) if sharded else str(i)]
        assert struct.unpack("<4fBBBB", v[:size]) == (np.float32(row.x), np.float32(row.y), np.float32(row.z), row.score, ["c", "b", "a"].index(row.kind), 1, 2, 255)
        assert struct.unpack("<IQ", v[size:]) == (1, int(row.body))
    seen = []
    for part in info["spatial"]:
        groups = index(spark, info, at, part)
        members = {k: unpack_group(v, size)[1] for k, v in groups.items()}
        assert max(map(len, members.values())) == part["limit"]
        seen += [i for m in members.values() for i in m]
        if not sharded:
            for name, m in members.items():
                cell = [int(c) for c in name.split("_")]
                for i in m:
                    at_ = [pdf.loc[np.uint64(i), a] for a in "xyz"]
                    want = [min(int((v - lo) / c), g - 1) for v, lo, c, g in zip(at_, info["lower_bound"], part["chunk_size"], part["grid_shape"])]
                    assert cell == want
    assert sorted(seen) == sorted(int(i) for i in ids)
    rel = index(spark, info, at, info["relationships"][0])
    assert {int(k): sorted(unpack_group(v, size)[1]) for k, v in rel.items()} == {int(b): sorted(int(i) for i in g.index) for b, g in pdf.groupby("body")}


def test_polylines_without_table(spark, tmp_path):
    v = spark.createDataFrame([(i, k, float(k), float(i), 0.0) for i, n in ((10, 3), (20, 2)) for k in range(n)], "annotation_id long, vertex int, x double, y double, z double")
    info = export_annotations(None, "xyz", "polyline", output_dir=str(tmp_path), polyline_points=v)
    by_id = index(spark, info, str(tmp_path), info["by_id"])
    assert struct.unpack("<I9f", by_id[10]) == (3, 0, 10, 0, 1, 10, 0, 2, 10, 0)
    assert len(by_id[20]) == 4 + 24


@pytest.mark.parametrize("kind", ["line", "axis_aligned_bounding_box", "ellipsoid"])
def test_switches_and_shapes(spark, tmp_path, kind):
    a, b = ("", "r") if kind == "ellipsoid" else ("a", "b")
    cols = [f"{c}{a}" for c in "xyz"] + [f"r{c}" if kind == "ellipsoid" else f"{c}{b}" for c in "xyz"]
    df = spark.range(50).select(F_("id"), *[(F_("id") % (k + 3) + k + 1).cast("int").alias(c) for k, c in enumerate(cols)]).withColumnRenamed("id", "annotation_id")
    info = export_annotations(df, "xyz", kind, output_dir=str(tmp_path), write_by_id=False, write_by_relationship=False, num_spatial_levels=1, target_chunk_limit=0, shuffle_spatial_ordering=False)
    assert info["by_id"] == {} and info["relationships"] == [] and info["spatial"][0]["limit"] == 1
    (v,) = index(spark, info, str(tmp_path), info["spatial"][0]).values()
    assert unpack_group(v, 24)[1] == list(range(50))


def F_(c):
    from pyspark.sql import functions as F

    return F.col(c)


@pytest.mark.parametrize("spec", [ShardSpec(0, 0, 3), ShardSpec(0, 0, 0, data_encoding="raw", minishard_index_encoding="raw")])
def test_container(spec):
    values = {k * k: bytes([k % 251]) * (k % 7) for k in range(300)}
    entries = sorted((spec.place(k)[1], k, v) for k, v in values.items())
    assert unpack_shard(pack_shard(entries, spec), spec) == values


def test_sources(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.feather
    import pyarrow.parquet

    pdf = pd.DataFrame({"x": [1.0, 2.0], "n": np.array([1, 2**64 - 1], np.uint64)}, index=pd.RangeIndex(1000, 1004, 2))
    assert [(r.annotation_id, r.n) for r in from_pandas(spark, pdf).collect()] == [(1000, 1), (1002, -1)]
    f = str(tmp_path / "a.feather")
    pyarrow.feather.write_feather(pa.Table.from_pandas(pdf.rename_axis("annotation_id")), f)
    assert sorted(r.annotation_id for r in from_feather(spark, f).collect()) == [1000, 1002]
    p = str(tmp_path / "a.parquet")
    pyarrow.parquet.write_table(pa.table({"annotation_id": pa.array([5, 2**64 - 2], pa.uint64())}), p)
    assert sorted(r.annotation_id for r in from_parquet(spark, p).collect()) == [signed(2**64 - 2), 5]
    assert read_annotations(spark, pa.table({"k": [7]}), "k").first().annotation_id == 7
    lists = pa.table({"annotation_id": [1], "rel": pa.array([[2**64 - 1, 3]], pa.list_(pa.uint64()))})
    assert from_arrow(spark, lists).first().rel == [-1, 3]
    with pytest.raises(TypeError):
        read_annotations(spark, 5)


def test_errors(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0, 1.0, "z", 300)], "annotation_id long, x double, y double, kind string, n int")
    with pytest.raises(ValueError):
        property_specs(df, ["kind"])
    with pytest.raises(ValueError):
        property_specs(df, ["missing"])
    with pytest.raises(ValueError):
        property_specs(df, [{"id": "n", "type": "int64"}])
    with pytest.raises(ValueError):
        export_annotations(df, "xy", "blob", output_dir=str(tmp_path))
    with pytest.raises(ValueError):
        export_annotations(df, "xyz", "point", output_dir=str(tmp_path))
    for p in ([{"id": "kind", "enum_labels": ["a"]}], [{"id": "n", "type": "uint8"}]):
        with pytest.raises(Exception, match="none of its labels|outside uint8"):
            export_annotations(df, "xy", "point", p, output_dir=str(tmp_path))
    assert CoordSpace.of("xy").names == ("x", "y")


def test_failed_export_leaves_the_old_one(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0, 2.0, "a"), (2, 3.0, 4.0, "b")], "annotation_id long, x double, y double, kind string")
    at = str(tmp_path / "out")
    info = export_annotations(df, "xy", "point", [{"id": "kind", "enum_labels": ["a", "b"]}], output_dir=at)
    with pytest.raises(Exception, match="none of its labels"):
        export_annotations(df, "xy", "point", [{"id": "kind", "enum_labels": ["a"]}], output_dir=at)
    assert json.loads(get_file(f"{at}/info")) == json.loads(json.dumps(info)) and len(index(spark, info, at, info["by_id"])) == 2
    again = export_annotations(df.where("annotation_id = 2"), "xy", "point", output_dir=at, sharded=False)
    assert list(index(spark, again, at, again["by_id"])) == ["2"]


def test_dropped_polylines_are_told(spark, tmp_path):
    v = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 2.0, 3.0), (9, 0, 5.0, 5.0)], "annotation_id long, vertex int, x double, y double")
    main = spark.createDataFrame([(1, [7, 8]), (4, None)], "annotation_id long, near array<long>")
    with pytest.warns(UserWarning, match="1 polylines have no vertices and 1 groups"):
        info = export_annotations(main, "xy", "polyline", relationships=["near"], output_dir=str(tmp_path), polyline_points=v)
    assert struct.unpack("<I4fI2Q", index(spark, info, str(tmp_path), info["by_id"])[1]) == (2, 0, 1, 2, 3, 2, 7, 8)


def test_shards_of_groups(spark):
    from annospark.functions.shardhash import with_shards
    from pyspark.sql import functions as F

    specs = {0: ShardSpec(2, 3, 1), 2: ShardSpec(0, 5, 4)}
    keys = [0, 1, 77, 2**63 + 5, 2**64 - 1]
    df = spark.createDataFrame([(g, signed(k)) for g in specs for k in keys], "grp long, key long")
    got = {(r.grp, unsigned(r.key)): (r.shard, r.minishard) for r in with_shards(df, F.col("grp"), F.col("key"), specs).collect()}
    assert got == {(g, k): s.place(k) for g, s in specs.items() for k in keys}


def test_a_shard_is_packed_from_entries_that_are_not_kept():
    """24-byte values take their bytes and 24 an entry, not objects of their own; reading holds a span."""
    import tracemalloc

    from annospark.sources import shards

    n, spec = 100_000, ShardSpec(0, 0, 4, data_encoding="raw")
    data = pack_shard(((k * 16 // n, k, k.to_bytes(24, "little")) for k in range(n)), spec)
    tracemalloc.start()
    assert pack_shard(((k * 16 // n, k, k.to_bytes(24, "little")) for k in range(n)), spec) == data
    packing = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert packing < 160 * n
    reads = []
    span = lambda start, end: reads.append(end - start) or data[start:end]
    old, shards.SPAN = shards.SPAN, 10_000
    try:
        assert [(k, int.from_bytes(v, "little")) for k, v in shards.shard_values(span, spec)] == [(k, k) for k in range(n)]
    finally:
        shards.SPAN = old
    assert max(reads) <= 60_000 and sum(reads) == len(data)


def test_large_groups_are_sorted_in_pieces(spark, tmp_path, monkeypatch):
    """A group of most rows is cut over tasks and whole in its file, in order; small ones share batches."""
    from annospark.operators import decode
    from annospark.sources import shards

    monkeypatch.setattr(shards, "PIECE_ROWS", 100)
    df = spark.range(2000, numPartitions=3).selectExpr("id * 7919 % 2003 as annotation_id", "cast(id as double) as x", "0.5d as y", "case when id % 10 = 0 then id % 7 else 100 end as body")
    want = {}
    for r in df.collect():
        want.setdefault(r.body, []).append(r.annotation_id)
    info = export_annotations(df, "xy", "point", relationships=["body"], output_dir=str(tmp_path), write_by_id=False, write_by_spatial_chunk=False)
    part = info["relationships"][0]
    got = index(spark, info, str(tmp_path), part)
    assert {k: unpack_group(v, 8)[1] for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    rows = shards.read_sharded_groups(spark, f"{tmp_path}/{part['key']}", spec_of(part["sharding"]), 8, 2).collect()
    assert sorted((r.key, r.seq, r.id) for r in rows) == sorted((k, i, x) for k, v in want.items() for i, x in enumerate(sorted(v)))
    monkeypatch.setattr(decode, "MOST_MEMBERS", 64)
    batches = list(decode.group_batches((((k,), v) for k, v in sorted(got.items())), 8, 2, [("key", __import__("pyarrow").int64())]))
    assert max(b.num_rows for b in batches) < 128 and [tuple(x) for b in batches for x in zip(*(b.column(i).to_pylist() for i in range(3)))] == sorted((r.key, r.seq, r.id) for r in rows)


def test_many_files_make_few_tasks(spark, tmp_path):
    """Files are read by a fixed number of tasks, however many there are, hidden ones are left out, and names may need quoting."""
    from annospark.sources.shards import put_file, write_files

    values = [(f"{tmp_path}/index/{k} %é", bytes([k % 256])) for k in range(1000)]
    assert write_files(spark.createDataFrame(values, "name string, value binary")) == 1000
    put_file(f"{tmp_path}/index/.hidden", b"x")
    df = read_files(spark, f"{tmp_path}/index")
    assert df.rdd.getNumPartitions() == 8
    assert {(r.name, bytes(r.value)) for r in df.collect()} == {(n.rpartition("/")[2], v) for n, v in values}


def test_distinct_ids_of_levels_are_dealt_first(spark, data):
    """export_spatial_shuffled: ids are dealt before they are made distinct, so no task holds those of a shard."""
    plan = export_spatial_shuffled(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and plan.count("HashAggregate") == 4  # dealt by (level, id), two steps for distinct ids, two for counts
    assert plan.rindex("HashAggregate") < plan.rindex("Exchange")
