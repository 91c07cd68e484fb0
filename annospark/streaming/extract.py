"""Annotations of a stream of viewer states, and counts per layer and time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annospark.operators.local import extract_states


def layer_counts(states: DataFrame, time_col: str, state_col: str = "state", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Annotations of each layer in tumbling windows; works on streams (rows later than ``late`` are dropped) and tables."""
    rows = extract_states(states.withWatermark(time_col, late), state_col, keep=[time_col])
    return rows.groupBy(F.window(time_col, window).alias("w"), "layer").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "layer", "n")
