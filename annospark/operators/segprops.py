"""Segment properties: table to columnar document and back.

Column types, dictionaries and codes are DataFrame work.  A :class:`Document`
keeps the columns as a table: it is read, selected from and written to its file
without the driver holding them; :func:`segment_properties` collects them into
the one JSON value that the viewer loads whole.
"""

from __future__ import annotations

import json
import posixpath
import shutil
import tempfile
import uuid
from collections.abc import Mapping, Sequence
from contextlib import ExitStack
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annospark.functions.bits import unsigned_text
from annospark.sources.shards import file_system

INFO_TYPE = "neuroglancer_segment_properties"  # fixed value of the format
ROW = "__row"
#: Entries of a tag dictionary that are broadcast to every task; a larger one is joined by shuffles.
MOST_BROADCAST = 100_000


def spread(df: DataFrame, segment: str = "segment") -> DataFrame:
    """``df`` dealt by ids to some tasks a core, if it is read by fewer than two a core: a compact file of millions of rows is one or two tasks, and a document is several passes of row by row work.

    Where the plan has shuffles already, these tell how many tasks there are.
    """
    jdf, cores = df._jdf, df.sparkSession.sparkContext.defaultParallelism
    if jdf.queryExecution().executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec" or jdf.rdd().getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(4 * cores, segment)


def drop_empty(df: DataFrame, segment: str = "segment") -> DataFrame:
    """Rows with a true boolean, or any other value that is not null and not ''."""
    keep = F.lit(False)
    for f in df.schema:
        if f.name in (segment, ROW):
            continue
        c = F.col(f.name)
        keep = keep | (F.coalesce(c, F.lit(False)) if isinstance(f.dataType, T.BooleanType) else F.coalesce(c != "", F.lit(False)) if isinstance(f.dataType, T.StringType) else c.isNotNull())
    return df.where(keep)


def scalar_types(df: DataFrame, segment: str = "segment", label: str | None = None, description: str | None = None, strings: Sequence[str] = (), numbers: Sequence[str] = (), tags: Sequence[str] = ()) -> dict[str, str]:
    """Property type of each scalar column, in column order: explicit lists first (description, label, number, string, tags win in this order), then name and type."""
    fields = {f.name: f.dataType for f in df.schema if f.name not in (segment, ROW)}
    given = dict.fromkeys(tags, "tags") | dict.fromkeys(strings, "string") | dict.fromkeys(numbers, "number") | ({label: "label"} if label else {}) | ({description: "description"} if description else {})
    if unknown := given.keys() - fields.keys():
        raise ValueError(f"columns not found: {sorted(unknown)}")
    numeric = {n: isinstance(t, T.NumericType) for n, t in fields.items()}
    if len(fields) == 1 and not given and not any(numeric.values()):
        given = dict.fromkeys(fields, "label")
    out = {}
    for n, t in fields.items():
        kind = given.get(n)
        if isinstance(t, T.BooleanType) and kind != "tags":
            raise ValueError(f"column {n}: booleans are only valid as tags")
        if kind == "number" and not numeric[n]:
            raise ValueError(f"column {n} is not numeric")
        kind = kind or (n if n in ("label", "description") else "number" if numeric[n] else "string")
        if kind != "tags":
            out[n] = kind
    return out


def number_types(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Stored type of each number column, from one aggregate; ValueError for NaN, nulls, or integers beyond 32 bits."""
    kinds = {f.name: f.dataType for f in df.schema}
    if not columns:
        return {}
    r = df.agg(*[x for i, c in enumerate(columns) for x in (F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"), F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(f"bad{i}"))]).first()
    out = {}
    for i, c in enumerate(columns):
        if r[f"bad{i}"]:
            raise ValueError(f"column {c} contains NaN or null")
        lo, hi, t = r[f"lo{i}"], r[f"hi{i}"], kinds[c]
        if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            out[c] = "float32"
        elif isinstance(t, (T.ByteType, T.ShortType)):
            out[c] = "int8" if isinstance(t, T.ByteType) else "int16"
        elif lo is None or lo >= -(1 << 31) and hi < 1 << 31:
            out[c] = "int32"
        elif lo >= 0 and hi < 1 << 32:
            out[c] = "uint32"
        else:
            raise ValueError(f"column {c} exceeds 32-bit integers")
    return out


def _clean(c: str) -> str:
    return c.replace(" ", "_").replace(":", "_")


def tag_value(df: DataFrame, column: str) -> Column:
    """A column's tag before prefixes: a true boolean is the column's name; '' is none; spaces become underscores."""
    if isinstance(df.schema[column].dataType, T.BooleanType):
        return F.when(F.col(column), F.lit(column.replace(" ", "_")))
    s = F.col(column).cast("string")
    return F.when(s != "", F.regexp_replace(s, " ", "_"))


def tag_dictionary(df: DataFrame, tags: Sequence[str], prefix: str | None = "all", sort: bool = False, orders: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``col, pos, value, tag, code``: each column's distinct values, their final tags and codes.

    Columns in the order given, values sorted within (``orders`` may give a
    column's own order); a tag's first place gives its code, or its rank if
    ``sort``.  The dictionary is as large as the distinct tags, which the
    document holds in one list anyway.
    """
    if prefix not in ("all", "disambiguate", None):
        raise ValueError(f"unknown prefix mode {prefix!r}")
    values = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), tag_value(df, c).alias("value")) for i, c in enumerate(tags)])).alias("t")).select("t.pos", "t.value").where(F.col("value").isNotNull()).distinct()
    flags = [isinstance(df.schema[c].dataType, T.BooleanType) for c in tags]
    name = F.element_at(F.lit([_clean(c) for c in tags]), F.col("pos") + 1)
    prefixed = F.concat(name, F.lit(":"), F.col("value"))
    if prefix == "all":
        d = values.withColumn("tag", F.when(F.element_at(F.lit(flags), F.col("pos") + 1), F.col("value")).otherwise(prefixed))
    elif prefix == "disambiguate":
        d = values.withColumn("tag", F.when(F.count(F.lit(1)).over(W.partitionBy("value")) > 1, prefixed).otherwise(F.col("value")))
    else:
        d = values.withColumn("tag", F.col("value"))
    rank = F.lit(0)
    for i, c in enumerate(tags):
        if orders and c in orders:
            rank = F.when(F.col("pos") == i, F.array_position(F.lit([str(x).replace(" ", "_") for x in orders[c]]), F.col("value"))).otherwise(rank)
    # the dictionary is small, so windows over it cost little; a grouped minimum would drop the distinct above and sort every row's tags
    first = d.withColumn("at", F.min(F.struct("pos", rank.cast("long").alias("rank"), "value")).over(W.partitionBy("tag")))
    # one sort of the dictionary alone: it is one list in the document
    code = F.dense_rank().over(W.orderBy(*(["tag"] if sort else ["at.pos", "at.rank", "at.value"]))) - 1
    return first.select(F.element_at(F.lit(list(tags)), F.col("pos") + 1).alias("col"), "pos", "value", "tag", code.alias("code"))


def with_codes(df: DataFrame, dictionary: DataFrame, tags: Sequence[str], distinct: bool = False) -> DataFrame:
    """``df`` with ``codes``: ascending codes of each row's tags.  distinct: a tag that two columns give counts once.

    A left join for each column, with the values as keys: rows are neither
    multiplied nor grouped, and stay where they are if the dictionary is small.
    """
    own, plain = df.columns, df
    for i, c in enumerate(tags):
        d = dictionary.where(F.col("pos") == i).select(F.col("value").alias(f"__v{i}"), F.col("code").alias(f"__c{i}"))
        df = df.join(d, tag_value(plain, c) == F.col(f"__v{i}"), "left")
    codes = F.array_sort(F.array_compact(F.array(*[F.col(f"__c{i}").cast("int") for i in range(len(tags))])))
    return df.select(*[F.col(f"`{c}`") for c in own], (F.array_distinct(codes) if distinct else codes).alias("codes"))


def tag_codes(df: DataFrame, dictionary: DataFrame, tags: Sequence[str], key: str = "segment", distinct: bool = False) -> DataFrame:
    """``key, codes`` of each row; see :func:`with_codes`."""
    return with_codes(df, dictionary, tags, distinct).select(key, "codes")


def _describe(tags: Sequence[str], given: Mapping[str, str]) -> list[str]:
    known = {str(k).replace(" ", "_"): v for k, v in given.items()}
    return [known.get(t) or known.get(t.partition(":")[2] if ":" in t else t) or t for t in tags]


@dataclass(frozen=True)
class Document:
    """A document with its columns in a table.

    rows: ``row`` (sorts as the document does), ``segment``, ``id``, ``v0, v1, ...`` of the scalars and ``codes`` if there are tags.
    properties: those of the document, in order, without their values.
    """

    rows: DataFrame
    properties: list[dict]

    def columns(self) -> list[str]:
        """Columns of ``rows`` that hold the ids and the properties' values, in order."""
        return ["id", *["codes" if p["type"] == "tags" else f"v{i}" for i, p in enumerate(self.properties)]]

    def to_dict(self) -> dict:
        """The JSON value, on the driver."""
        rows = self.rows.orderBy("row").select(*self.columns()).collect()
        values = [[r[k] if p["type"] != "tags" else list(r[k]) for r in rows] for k, p in enumerate(self.properties, 1)]
        return {"@type": INFO_TYPE, "inline": {"ids": [r.id for r in rows], "properties": [_with_values(p, v) for p, v in zip(self.properties, values)]}}

    def write(self, path: str) -> None:
        """The document's file: the driver passes on pieces of text, a partition's at a time, and keeps each column in a local file until its turn."""
        names = self.columns()

        def run(batches):
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_pydict({f"t{i}": [json.dumps(c.to_pylist())[1:-1]] for i, c in enumerate(b.columns)})

        path = path if path.endswith(".json") else f"{path}/info"
        fs, p = file_system(path)
        own = f"{posixpath.dirname(p)}/.{posixpath.basename(p)}.{uuid.uuid4().hex}"
        with ExitStack() as stack:
            parts = [stack.enter_context(tempfile.TemporaryFile("w+", encoding="ascii")) for _ in names]
            text = self.rows.orderBy("row").select(*names).mapInArrow(run, ", ".join(f"t{i} string" for i in range(len(names))))
            for k, r in enumerate(text.toLocalIterator()):
                for f, t in zip(parts, r):
                    f.write(f", {t}" if k else t)
            fs.create_dir(posixpath.dirname(p), recursive=True)
            with fs.open_output_stream(own) as out:
                for k, (f, prop) in enumerate(zip(parts, [None, *self.properties])):
                    mark = json.dumps(uuid.uuid4().hex)
                    head = f'{{"@type": {json.dumps(INFO_TYPE)}, "inline": {{"ids": [' if prop is None else ""
                    before, after = ("", "]") if prop is None else json.dumps(_with_values(prop, json.loads(mark))).split(mark)
                    out.write((head or (", " if k > 1 else ', "properties": [') + before + "[").encode())
                    f.seek(0)
                    shutil.copyfileobj(f.buffer, out, 1 << 20)
                    out.write((after if prop is None else "]" + after).encode())
                out.write(b"]}}" if self.properties else b', "properties": []}}')
        fs.move(own, p)


def _with_values(prop: Mapping, values) -> dict:
    """The property with its values, before the descriptions."""
    last = {k: v for k, v in prop.items() if k in ("description", "tag_descriptions")}
    return {k: v for k, v in prop.items() if k not in last} | {"values": values} | last


def segment_document(
    df: DataFrame, label: str | None = None, *, segment: str = "segment", description: str | None = None, strings: Sequence[str] = (), numbers: Sequence[str] = (), tags: Sequence[str] = (),
    tag_prefix_mode: str | None = "all", sort_tags: bool = False, tag_descriptions: Mapping[str, str] | None = None, col_descriptions: Mapping[str, str] | None = None, drop_empty_rows: bool = True,
    order_col: str | None = None, tag_orders: Mapping[str, Sequence[str]] | None = None, distinct_codes: bool = False,
) -> Document:
    """The document of a table; rows in order of ``order_col`` (default: of the segment id).  The driver holds the distinct tags alone."""
    as_list = lambda x: [x] if isinstance(x, str) else list(x)
    strings, numbers, tags = as_list(strings), as_list(numbers), as_list(tags)
    for c in [c for g in (strings, numbers, tags) for c in g if c == segment]:
        raise ValueError(f"{c} is the segment id")
    if len(set(df.columns)) != len(df.columns) or any(len(set(g)) != len(g) for g in (strings, numbers, tags)):
        raise ValueError("columns are repeated")
    order = F.col(order_col or segment)
    df = spread(df, segment).withColumn(ROW, order).drop(*([order_col] if order_col and order_col != segment and order_col not in {*strings, *numbers, *tags, label, description} else []))
    if drop_empty_rows:
        df = drop_empty(df, segment)
    types = scalar_types(df, segment, label, description, strings, numbers, tags)
    stored = number_types(df, [c for c, t in types.items() if t == "number"])
    props = []
    for c, t in types.items():
        p = {"id": c, "type": t} | ({"data_type": stored[c]} if t == "number" else {})
        props.append(p | ({"description": col_descriptions[c]} if (col_descriptions or {}).get(c) else {}))
    cols = [F.struct(F.col(ROW), F.col(segment)).alias("row"), F.col(segment).alias("segment"), unsigned_text(F.col(segment)).alias("id")]
    cols += [(F.col(c) if t == "number" else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"v{i}") for i, (c, t) in enumerate(types.items())]
    if tags:
        entries = tag_dictionary(df, tags, tag_prefix_mode, sort_tags, tag_orders).select("pos", "value", "tag", "code").collect()
        names = [t for _, t in sorted({(r.code, r.tag) for r in entries})]
        dictionary = df.sparkSession.createDataFrame([(r.pos, r.value, r.code) for r in entries], "pos int, value string, code int")
        df = with_codes(df.where(F.col(segment).isNotNull()), F.broadcast(dictionary) if len(entries) <= MOST_BROADCAST else dictionary, tags, distinct_codes)
        cols.append(F.col("codes"))
        props.append({"id": "tags", "type": "tags", "tags": names} | ({"tag_descriptions": _describe(names, tag_descriptions)} if tag_descriptions else {}))
    return Document(df.select(*cols), props)


def segment_properties(df: DataFrame, label: str | None = None, *, output_path: str | None = None, **given) -> dict:
    """The document of a table as one JSON value, see :func:`segment_document`; ``output_path``: its file, or the folder of its ``info``."""
    doc = segment_document(df, label, **given)
    if output_path:
        doc.write(output_path)
    return doc.to_dict()


_KINDS = {"int8": "tinyint", "int16": "smallint", "int32": "int", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "float32": "float"}


def segment_table(spark: SparkSession, info: Mapping | Document, consolidate: bool = True, separate: bool = False):
    """The table of a document: ``segment``, scalars, and a column a tag prefix (or a boolean a tag).

    A dict is one driver value, whose columns become rows by one explode; a
    :class:`Document` has them as rows.
    """
    kind = lambda p: _KINDS.get(p.get("data_type", ""), "double" if p["type"] == "number" else "string")
    if isinstance(info, Document):
        scalars = [p for p in info.properties if p["type"] != "tags"]
        tag_prop = next((p for p in info.properties if p["type"] == "tags"), None)
        df = info.rows
        values = [F.col(f"v{i}") for i in range(len(scalars))]
    else:
        inline = info["inline"]
        scalars = [p for p in inline["properties"] if p["type"] != "tags"]
        tag_prop = next((p for p in inline["properties"] if p["type"] == "tags"), None)
        text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v)
        data = [(i, int(s), [text(p["values"][i]) for p in scalars], list(tag_prop["values"][i]) if tag_prop else []) for i, s in enumerate(inline["ids"])]
        df = spark.createDataFrame(data, "row long, segment long, v array<string>, codes array<int>")
        values = [F.col("v")[i] for i in range(len(scalars))]
    scalar_cols = {p["id"]: v.cast(kind(p)).alias(p["id"]) for p, v in zip(scalars, values)}
    tag_cols = {n: c.alias(n) for n, c in tag_columns(tag_prop["tags"], consolidate).items()} if tag_prop else {}
    full = df.select("row", "segment", *[c for n, c in scalar_cols.items() if n not in tag_cols], *tag_cols.values())
    if separate:
        return full, list(tag_cols)
    return full.orderBy("row").drop("row")


def tag_columns(tags: Sequence[str], consolidate: bool = True) -> dict[str, Column]:
    """A column of ``codes`` for each tag prefix, holding the tag's rest (of several the last); or a boolean for each tag."""
    if not consolidate:
        return {t: F.array_contains("codes", i) for i, t in enumerate(tags)}
    prefixes = list(dict.fromkeys(t.partition(":")[0] for t in tags))
    place = {p: k for k, p in enumerate(prefixes)}
    of = F.lit([place[t.partition(":")[0]] for t in tags])
    rest = F.lit([t.partition(":")[2] if ":" in t else t for t in tags])
    mine = lambda k: lambda c: F.element_at(of, c + 1) == k
    return {p: F.when(F.exists("codes", mine(k)), F.element_at(rest, F.element_at(F.filter("codes", mine(k)), -1) + 1)) for p, k in place.items()}
