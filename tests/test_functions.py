import random

import pytest
from annospark.functions import morton, shardhash
from annospark.functions.bits import from_decimal, signed, unsigned, unsigned_order, unsigned_text
from annospark.functions.colors import packed, unpack, with_color
from annospark.functions.shardhash import ShardSpec, choose_spec, low64, with_low64, with_shard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def test_low64_known_values():
    assert [low64(k) for k in (0, 1, 42)] == [0x4772B084E028AE41, 0xE8BD67D616D4CE9A, 0xC20B94F95119F47A]


def test_low64_column_is_the_plain_one(spark):
    r = random.Random(1)
    keys = [0, 1, 42, (1 << 63) - 1, -(1 << 63), -1] + [signed(r.getrandbits(64)) for _ in range(300)]
    df = with_low64(spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long"), F.col("k"))
    assert all(row.hash is None if row.k is None else unsigned(row.hash) == low64(unsigned(row.k)) for row in df.collect())


@pytest.mark.parametrize("spec", [ShardSpec(0, 4, 3), ShardSpec(2, 5, 4), ShardSpec(10, 0, 4), ShardSpec(0, 4, 3, "identity_hash"), ShardSpec(8, 3, 2, "identity_hash")])
def test_placement(spark, spec):
    r = random.Random(2)
    df = with_shard(spark.createDataFrame([(signed(r.getrandbits(64)),) for _ in range(200)], "k long"), F.col("k"), spec)
    assert all((row.shard, row.minishard) == spec.place(unsigned(row.k)) for row in df.collect())


def test_choose_spec():
    s = choose_spec(192, 14_000_000_000, 511)
    assert (s.shard_bits, s.preshift_bits) == (9, 0)
    assert choose_spec(300_000_000, 30_000_000_000, 1 << 40).preshift_bits == 10
    assert choose_spec(192, 14_000_000_000).preshift_bits == 10
    with pytest.raises(ValueError):
        choose_spec(1, 1, hash="md5")


def test_morton_known_values():
    for shape in ((5, 16, 3), (10, 32, 6)):
        assert morton.encode_int((3, 5, 1), shape) == 143
        assert morton.encode_int((4, 3, 2), shape) == 114
    with pytest.raises(ValueError):
        morton.encode_int((5, 0, 0), (5, 16, 3))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), min_size=1, max_size=4), st.randoms())
def test_morton_round_trip(shape, r):
    cell = tuple(r.randrange(n) for n in shape)
    code = morton.encode_int(cell, shape)
    assert morton.decode_int(code, shape) == cell
    assert 0 <= code < 1 << sum((n - 1).bit_length() for n in shape)


def test_morton_columns(spark):
    df = spark.range(400).select((F.col("id") % 5).alias("x"), (F.col("id") % 16).alias("y"), (F.col("id") % 3).alias("z"))
    code = morton.encode([F.col(c) for c in "xyz"], (5, 16, 3))
    for r in df.withColumn("c", code).collect():
        assert r.c == morton.encode_int((r.x, r.y, r.z), (5, 16, 3))


def test_colors(spark):
    want = {1: "#5e80ff", 818314: "#ffb24e", 800181: "#ffa838", (1 << 32) + 1: "#ff12ae", None: None}
    df = with_color(spark.createDataFrame([(k,) for k in want], "k long"), F.col("k"))
    assert {r.k: r.color for r in df.collect()} == want
    assert with_color(spark.createDataFrame([(1,)], "k long"), F.col("k"), seed=7).first().color == "#5e80ff"
    r = df.where("k = 1").select(packed(F.col("color")).alias("p"), *[c.alias(n) for c, n in zip(unpack(F.col("color")), "rgb")]).first()
    assert tuple(r) == (0x5E80FF, 0x5E, 0x80, 0xFF)


def test_unsigned(spark):
    values = [0, 1, (1 << 63) - 1, 1 << 63, (1 << 64) - 1]
    df = spark.createDataFrame([(signed(v),) for v in values], "v long")
    assert [int(r[0]) for r in df.orderBy(unsigned_order(F.col("v"))).select(unsigned_text(F.col("v"))).collect()] == values
    df = spark.createDataFrame([(str(v),) for v in values], "v string").select(from_decimal(F.col("v").cast("decimal(20,0)")).alias("x"))
    assert [unsigned(r.x) for r in df.collect()] == values
    assert shardhash.ShardSpec(0, 9, 0).file_name(3) == "003.shard"
