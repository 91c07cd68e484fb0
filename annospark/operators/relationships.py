"""Related segments of annotations: scalar or list columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_list(df: DataFrame, column: str) -> Column:
    """The related ids in the user's order, duplicates kept; an empty list for null, null members dropped."""
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return F.coalesce(F.filter(F.col(column).cast("array<bigint>"), lambda x: x.isNotNull()), F.array().cast("array<bigint>"))
    return F.when(F.col(column).isNotNull(), F.array(F.col(column).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def pairs(df: DataFrame, column: str, *keep: str, segment: str = "segment") -> DataFrame:
    """A row for each distinct (annotation, segment); duplicates go before the explosion, so nothing is shuffled."""
    return df.select(*keep, F.explode(F.array_distinct(as_list(df, column))).alias(segment))


def group_counts(df: DataFrame, column: str, id_col: str = "annotation_id") -> DataFrame:
    return pairs(df, column, id_col).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


def restrict_to(df: DataFrame, ids: DataFrame, id_col: str = "annotation_id") -> DataFrame:
    """Rows whose id is in ``ids``."""
    return df.join(ids.select(id_col), id_col, "left_semi")
