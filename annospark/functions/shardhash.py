"""Shard placement: the low 64 bits of murmur3_x86_128 of a 64-bit key, and the layout heuristic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annospark.functions.bits import MASK32, Stages, mul32, rotl32, signed

# The hash's constants and the layout's targets.
C1, C2, C3 = 0x239B961B, 0xAB0E9789, 0x38B34AE5
MIX1, MIX2 = 0x85EBCA6B, 0xC2B2AE35
MINISHARD_KEYS, SHARD_BYTES, MOST_PRESHIFT = 1000, 50_000_000, 10
SPEC_TYPE = "neuroglancer_uint64_sharded_v1"


@dataclass(frozen=True)
class ShardSpec:
    preshift_bits: int
    shard_bits: int
    minishard_bits: int
    hash: str = "murmurhash3_x86_128"
    data_encoding: str = "gzip"
    minishard_index_encoding: str = "gzip"

    def to_json(self) -> dict:
        return {"@type": SPEC_TYPE, "hash": self.hash, "preshift_bits": self.preshift_bits, "shard_bits": self.shard_bits, "minishard_bits": self.minishard_bits, "data_encoding": self.data_encoding, "minishard_index_encoding": self.minishard_index_encoding}

    def file_name(self, shard: int) -> str:
        return f"{shard:0{max(1, -(-self.shard_bits // 4))}x}.shard"

    def place(self, key: int) -> tuple[int, int]:
        """(shard, minishard) of an unsigned key."""
        h = key >> self.preshift_bits
        h = low64(h) if self.hash != "identity_hash" else h
        mini = h & ((1 << self.minishard_bits) - 1)
        return (h >> self.minishard_bits) & ((1 << self.shard_bits) - 1), mini


def choose_spec(count: int, total_bytes: int, max_key: int = (1 << 64) - 1, hash: str = "murmurhash3_x86_128", gzip: bool = True) -> ShardSpec:
    """About a thousand keys a minishard and 50 MB a shard; near keys share a minishard as far as the key space has bits to spare."""
    if hash not in ("murmurhash3_x86_128", "identity_hash"):
        raise ValueError(f"unknown shard hash {hash!r}")
    least = lambda n, most: next(b for b in range(65) if n >> b <= most)
    groups, shard = least(count, MINISHARD_KEYS), least(total_bytes, SHARD_BYTES)
    mini = max(0, groups - shard)
    encoding = "gzip" if gzip else "raw"
    return ShardSpec(min(MOST_PRESHIFT, max(0, max_key.bit_length() - shard - mini)), shard, mini, hash, encoding, encoding)


def low64(key: int) -> int:
    """The hash of one unsigned key, in plain Python (driver and tests)."""
    m = MASK32
    rot = lambda x, n: (x << n | x >> (32 - n)) & m
    h1 = 8 ^ (rot((key & m) * C1 & m, 15) * C2 & m)
    h2 = 8 ^ (rot((key >> 32) * C2 & m, 16) * C3 & m)
    h3 = 8  # the other two words are alike throughout
    h1 = (h1 + h2 + 2 * h3) & m
    h2, h3 = (h2 + h1) & m, (h3 + h1) & m

    def mix(h: int) -> int:
        h = (h ^ h >> 16) * MIX1 & m
        h = (h ^ h >> 13) * MIX2 & m
        return h ^ h >> 16

    h1, h2, h3 = mix(h1), mix(h2), mix(h3)
    h1 = (h1 + h2 + 2 * h3) & m
    return h1 | ((h2 + h1) & m) << 32


def with_low64(df: DataFrame, key: Column, out: str = "hash") -> DataFrame:
    """``df`` with the hash of a long column's bits, as a long; null for a null key."""
    s, word = Stages(df), lambda c: c.bitwiseAND(F.lit(MASK32))
    k = s.let(key)
    a = s.let(mul32(s.let(rotl32(s.let(mul32(s.let(word(k)), C1)), 15)), C2))
    b = s.let(mul32(s.let(rotl32(s.let(mul32(s.let(F.shiftrightunsigned(k, 32)), C2)), 16)), C3))
    eight = F.lit(8).cast("long")
    h2 = s.let(eight.bitwiseXOR(b))
    h1 = s.let(word(eight.bitwiseXOR(a) + h2 + 16))
    h2 = s.let(word(h2 + h1))
    h3 = s.let(word(h1 + 8))

    def mix(h: Column) -> Column:
        h = s.let(mul32(s.let(h.bitwiseXOR(F.shiftrightunsigned(h, 16))), MIX1))
        h = s.let(mul32(s.let(h.bitwiseXOR(F.shiftrightunsigned(h, 13))), MIX2))
        return s.let(h.bitwiseXOR(F.shiftrightunsigned(h, 16)))

    h1, h2, h3 = mix(h1), mix(h2), mix(h3)
    h1 = s.let(word(h1 + h2 + h3 * 2))
    return s.done(**{out: h1.bitwiseOR(F.shiftleft(word(h2 + h1), 32))})


def with_shard(df: DataFrame, key: Column, spec: ShardSpec, shard: str = "shard", minishard: str = "minishard") -> DataFrame:
    """``df`` with the shard and minishard of a key: computed columns, so placement needs no join."""
    shifted = F.shiftrightunsigned(key, spec.preshift_bits)
    own = df.columns
    df = with_low64(df, shifted, "__h") if spec.hash != "identity_hash" else df.withColumn("__h", shifted)
    h, mini = F.col("__h"), F.lit((1 << spec.minishard_bits) - 1).cast("long")
    at = F.shiftrightunsigned(h, spec.minishard_bits).bitwiseAND(F.lit(signed((1 << spec.shard_bits) - 1)).cast("long"))
    return df.select(*own, at.alias(shard), h.bitwiseAND(mini).alias(minishard))


def with_shards(df: DataFrame, group: Column, key: Column, specs: dict[int, ShardSpec]) -> DataFrame:
    """``df`` with ``shard`` and ``minishard`` by the spec of each row's group (small numbers): one hash, whatever the number of specs."""
    every = [specs.get(g, ShardSpec(0, 0, 0)) for g in range(max(specs) + 1)]
    if {s.hash for s in specs.values()} == {"identity_hash"}:
        hashed = lambda d: d.withColumn("__h", F.col("__k"))
    elif "identity_hash" in {s.hash for s in specs.values()}:
        raise ValueError("groups of one table have one hash")
    else:
        hashed = lambda d: with_low64(d, F.col("__k"), "__h")
    of = lambda values, kind: F.element_at(F.lit(values).cast(f"array<{kind}>"), group.cast("int") + 1)
    own = df.columns
    df = hashed(df.withColumn("__k", F.call_function("shiftrightunsigned", key, of([s.preshift_bits for s in every], "int"))))
    mini = F.col("__h").bitwiseAND(of([signed((1 << s.minishard_bits) - 1) for s in every], "bigint"))
    at = F.call_function("shiftrightunsigned", F.col("__h"), of([s.minishard_bits for s in every], "int")).bitwiseAND(of([signed((1 << s.shard_bits) - 1) for s in every], "bigint"))
    return df.select(*own, at.alias("shard"), mini.alias("minishard"))
