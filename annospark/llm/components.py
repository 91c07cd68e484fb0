"""Connected components of a graph given as a table of edges: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annospark.llm.common import Steps


def _to_smallest(directed: DataFrame) -> DataFrame:
    """u, v and m: the smallest of u and its neighbours; the minimum is taken before the shuffle and joined back (a hub's edges are split by the adaptive skew join)."""
    m = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return directed.join(m, "u")


def components(edges: DataFrame, steps: Steps) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node of ``edges`` (u, v: longs), a table of ``steps``; an empty graph has none.

    Repeated edges and loops change nothing; an edge with a null end is none.
    """
    e = steps.write(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_smallest(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        t = _to_smallest(large)
        small = t.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(t.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        last, e = e, steps.write(small, "edges")
        steps.drop(last)
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    labels = steps.write(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct(), "labels")
    steps.drop(e)
    return labels
