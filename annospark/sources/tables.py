"""Annotation tables from pandas, Arrow, Feather or Parquet, with a long ``annotation_id``.

Unsigned 64-bit columns become longs with the same bits.  Dictionary columns
become strings that keep their labels, in order, in the column's metadata; so
do narrow unsigned types keep theirs.  Ids: the named column, else the pandas
index (a range index counts on from its start), else the position.
"""

from __future__ import annotations

import json
from itertools import accumulate

import pyarrow as pa
import pyarrow.feather
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annospark.functions.bits import from_decimal

ID = "annotation_id"
#: Files of a table whose offsets are broadcast; of more they are joined.
MOST_FILES = 100_000


def _plain(column: pa.ChunkedArray) -> tuple[pa.ChunkedArray, dict]:
    t = column.type
    if pa.types.is_dictionary(t):
        labels = column.unify_dictionaries().chunk(0).dictionary.to_pylist() if column.num_chunks else []
        return column.cast(t.value_type), {"enum_labels": [str(x) for x in labels]}
    if pa.types.is_uint64(t):
        return pa.chunked_array([c.view(pa.int64()) for c in column.chunks], pa.int64()), {}
    if pa.types.is_list(t) and pa.types.is_uint64(t.value_type):
        return pa.chunked_array([pa.ListArray.from_arrays(c.offsets, c.values.view(pa.int64()), mask=c.is_null() if c.null_count else None) for c in (pa.concat_arrays([k]) for k in column.chunks)], pa.list_(pa.int64())), {}
    wider = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64()}
    if t in wider:
        return column.cast(wider[t]), {"property_type": str(t)}
    return column, {}


def from_arrow(spark: SparkSession, t: pa.Table, id_col: str | None = None) -> DataFrame:
    meta = json.loads((t.schema.metadata or {}).get(b"pandas", b"{}"))
    index = (meta.get("index_columns") or [None])[0]
    if id_col or ID in t.column_names:
        t = t.rename_columns([ID if c == (id_col or ID) else c for c in t.column_names])
    elif isinstance(index, str) and index in t.column_names:
        t = t.rename_columns([ID if c == index else c for c in t.column_names])
    else:
        start, step = (index["start"], index["step"]) if isinstance(index, dict) else (0, 1)
        t = t.append_column(ID, pa.array(range(start, start + step * t.num_rows, step), pa.int64()))
    columns, notes = {}, {}
    for name, column in zip(t.column_names, t.columns):
        columns[name], notes[name] = _plain(column)
    df = spark.createDataFrame(pa.table(columns))
    return df.select(*[F.col(n).cast("long").alias(n) if n == ID else F.col(n).alias(n, metadata=m) if m else F.col(n) for n, m in notes.items()])


def from_pandas(spark: SparkSession, pdf, id_col: str | None = None) -> DataFrame:
    return from_arrow(spark, pa.Table.from_pandas(pdf), id_col)


def from_feather(spark: SparkSession, path: str, id_col: str | None = None) -> DataFrame:
    return from_arrow(spark, pyarrow.feather.read_table(path, memory_map=True), id_col)


def _with_positions(df: DataFrame) -> DataFrame:
    """Counts rows a file (footers alone are read), and adds to each row's index what the files before have."""
    counts = sorted((r[0], r[1]) for r in df.groupBy(F.col("_metadata.file_path").alias("f")).count().collect())  # as many as the driver has listed
    names, starts = [f for f, _ in counts], [0, *accumulate(n for _, n in counts)]
    if len(names) < 2:
        return df.withColumn(ID, F.col("_metadata.row_index"))
    offsets = df.sparkSession.createDataFrame(list(zip(names, starts)), "__file string, __start long")
    at = df.withColumns({"__path": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")})
    joined = at.join(F.broadcast(offsets) if len(names) <= MOST_FILES else offsets, F.col("__path") == F.col("__file"))
    return joined.withColumn(ID, F.col("__start") + F.col("__row")).drop("__path", "__row", "__file", "__start")


def from_parquet(spark: SparkSession, path: str, id_col: str | None = None) -> DataFrame:
    """The native path: lazy, split by Spark.  Without an id column, the row's position in the table, whose files come in order of their paths."""
    df = spark.read.parquet(path)
    if id_col or ID in df.columns:
        df = df.withColumnRenamed(id_col or ID, ID)
    else:
        df = _with_positions(df)
    return df.select(*[from_decimal(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "decimal(20,0)" else F.col(f.name).cast("long").alias(f.name) if f.name == ID else F.col(f.name) for f in df.schema])


def read_annotations(spark: SparkSession, source, id_col: str | None = None) -> DataFrame:
    """Any of the above, by type or file name."""
    if isinstance(source, DataFrame):
        return source.withColumnRenamed(id_col, ID) if id_col else source
    if isinstance(source, pa.Table):
        return from_arrow(spark, source, id_col)
    if isinstance(source, str):
        return (from_feather if source.endswith((".feather", ".arrow")) else from_parquet)(spark, source, id_col)
    if hasattr(source, "columns") and hasattr(source, "index"):
        return from_pandas(spark, source, id_col)
    raise TypeError(f"not an annotation table: {type(source).__name__}")
