"""Exact sampling into levels without a global sort.

A row's rank is its place in the order of a key: a hash of its id (a uniform
permutation, the same on every retry) or a given order.  Level quotas only
need the keys at the quotas' ends, so rows are counted in ranges of keys, and
only the ranges that hold an end are ranked.  The level of a row then compares
its key with a few constants, with no shuffle of the table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annospark.functions.bits import unsigned_order


#: Rows of a range that one task ranks; a key with more is cut by its ids.
MOST_RANKED = 100_000


def shuffled_key(id_col: str = "annotation_id", seed: int = 0) -> Column:
    return F.xxhash64(F.col(id_col), F.lit(seed))


def level_cuts(df: DataFrame, key: Column, sizes: Sequence[int], id_col: str = "annotation_id", ranges: int = 4096) -> list[tuple[int, int, int]]:
    """(level, key, unsigned-ordered id) of the last row of each level but the last one that has rows."""
    full = [i for i, n in enumerate(sizes) if n]
    ends = dict(zip(range(len(sizes)), accumulate(sizes)))
    wanted = {i: ends[i] for i in full[:-1]}
    if not wanted:
        return []
    rows = df.select(key.cast("long").alias("k"), unsigned_order(F.col(id_col)).alias("o"))
    got = rows.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 4 * ranges).alias("b")).first().b
    tied = {k for k, n in Counter(got).items() if n > 1 and k < (1 << 63) - 1}  # keys of more rows than a range: each is a range of its own
    bounds = sorted({*got, *(k + 1 for k in tied)})
    step = 64
    runs = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col("k")))
    run = below(F.lit([r[0] for r in runs]).cast("array<bigint>"))
    nested = F.array(*[F.lit(r).cast("array<bigint>") for r in runs])
    at = F.when(run == 0, 0).otherwise((run - 1) * step + below(F.element_at(nested, F.greatest(run, F.lit(1)))))
    rows = rows.withColumn("at", at)
    sums, before = {}, 0
    for r in sorted(rows.groupBy("at").count().collect(), key=lambda r: r["at"]):  # as many as ranges
        sums[r["at"]] = (before, before + r["count"])
        before += r["count"]
    place = {i: next((a, end - s) for a, (s, e) in sums.items() if s < end <= e) for i, end in wanted.items()}
    found, tied_at = {}, {}
    for i, (a, r) in list(place.items()):
        k, n = bounds[a - 1] if a else None, sums[a][1] - sums[a][0]
        if k in tied and n > MOST_RANKED:  # ids tell its rows apart, and are found in ranges as keys are
            ids = rows.where(F.col("k") == k).select("o")
            found[place.pop(i)] = (k, level_cuts(ids, F.col("o"), [r, n - r], "o", ranges)[0][1] if r < n else ids.agg(F.max("o")).first()[0])
            tied_at[i] = (a, r)
    ranked = rows.where(F.col("at").isin(sorted({a for a, _ in place.values()}))).withColumn("r", F.row_number().over(W.partitionBy("at").orderBy("k", "o")))
    hit = F.lit(False)
    for a, r in place.values():
        hit = hit | ((F.col("at") == a) & (F.col("r") == r))
    if place:
        found |= {(r["at"], r["r"]): (r["k"], r["o"]) for r in ranked.where(hit).collect()}
    place |= tied_at
    return [(i, *found[place[i]]) for i in sorted(place)]


def with_level(df: DataFrame, sizes: Sequence[int], key: Column, id_col: str = "annotation_id", out: str = "level") -> DataFrame:
    """``df`` with each row's level; level i gets exactly ``sizes[i]`` rows, in order of (key, unsigned id)."""
    cuts = level_cuts(df, key, sizes, id_col)
    last = max((i for i, n in enumerate(sizes) if n), default=0)
    df = df.withColumn("__k", key.cast("long")).withColumn("__o", unsigned_order(F.col(id_col)))
    level = F.lit(last)
    for i, k, o in reversed(cuts):
        level = F.when((F.col("__k") < k) | ((F.col("__k") == k) & (F.col("__o") <= o)), F.lit(i)).otherwise(level)
    return df.withColumn(out, level).drop("__k", "__o")
