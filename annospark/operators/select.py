"""Projection and computed columns over segment properties: templates, copies, and a small safe expression language."""

from __future__ import annotations

import ast
import re
import string
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annospark.operators.segprops import Document, segment_document, segment_table

#: Distinct values up to which the default macros take a column.
FEW = 1000
CHOSEN = "__chosen"
MACROS = ("_all", "_all_tags", "_default", "_default_tags")

_ARITHMETIC = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Mod: lambda a, b: a % b}
_COMPARE = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}


def template_names(text: str) -> list[str]:
    try:
        return [name for _, name, *_ in string.Formatter().parse(text) if name]
    except ValueError:
        return []


def compile_expression(text: str, columns: Mapping[str, Column], strings: set[str] = frozenset()) -> Column:
    """A Column of an expression: arithmetic, comparisons, and/or/not (also & | ~), in. Anything else is a ValueError."""

    def is_text(n: ast.AST) -> bool:
        return isinstance(n, ast.Constant) and isinstance(n.value, str) or isinstance(n, ast.Name) and n.id in strings or isinstance(n, ast.BinOp) and is_text(n.left) and is_text(n.right)

    def walk(n: ast.AST) -> Column:
        match n:
            case ast.Expression():
                return walk(n.body)
            case ast.Constant() if isinstance(n.value, (int, float, str, bool)):
                return F.lit(n.value)
            case ast.Name():
                if n.id not in columns:
                    raise ValueError(f"unknown column {n.id!r}")
                return columns[n.id]
            case ast.BinOp(op=ast.Add()) if is_text(n.left) and is_text(n.right):
                return F.concat(walk(n.left), walk(n.right))
            case ast.BinOp(op=ast.Div()):
                b = walk(n.right).cast("double")
                return walk(n.left).cast("double") / F.when(b != 0, b)
            case ast.BinOp(op=ast.FloorDiv()):
                b = walk(n.right)
                return F.floor(walk(n.left) / F.when(b != 0, b))
            case ast.BinOp(op=ast.Pow()):
                return F.pow(walk(n.left), walk(n.right))
            case ast.BinOp(op=ast.BitAnd()):
                return walk(n.left) & walk(n.right)
            case ast.BinOp(op=ast.BitOr()):
                return walk(n.left) | walk(n.right)
            case ast.BinOp() if type(n.op) in _ARITHMETIC:
                return _ARITHMETIC[type(n.op)](walk(n.left), walk(n.right))
            case ast.UnaryOp(op=ast.USub()):
                return -walk(n.operand)
            case ast.UnaryOp(op=ast.UAdd()):
                return walk(n.operand)
            case ast.UnaryOp(op=ast.Not() | ast.Invert()):
                return ~walk(n.operand)
            case ast.BoolOp():
                return reduce(lambda a, b: a & b if isinstance(n.op, ast.And) else a | b, map(walk, n.values))
            case ast.Compare():
                left, out = n.left, None
                for op, right in zip(n.ops, n.comparators):
                    if isinstance(op, (ast.In, ast.NotIn)):
                        if not isinstance(right, (ast.Tuple, ast.List, ast.Set)):
                            raise ValueError("in needs a list of constants")
                        c = walk(left).isin(*[ast.literal_eval(x) for x in right.elts])
                        c = ~c if isinstance(op, ast.NotIn) else c
                    elif type(op) in _COMPARE:
                        if is_text(left) != is_text(right) and isinstance(op, (ast.Eq, ast.NotEq)):
                            c = F.lit(isinstance(op, ast.NotEq))  # a text and a number are never equal
                        else:
                            c = _COMPARE[type(op)](walk(left), walk(right))
                    else:
                        raise ValueError(f"unsupported comparison in {text!r}")
                    out, left = c if out is None else out & c, right
                return out
        raise ValueError(f"unsupported expression {text!r}")

    try:
        return walk(ast.parse(text, mode="eval"))
    except SyntaxError as e:
        raise ValueError(f"invalid expression {text!r}") from e


def _template(text: str, columns: Mapping[str, Column], kinds: Mapping[str, T.DataType]) -> Column:
    names = template_names(text)
    if unknown := set(names) - columns.keys():
        raise ValueError(f"invalid segment properties: {', '.join(sorted(unknown))}")
    parts = []
    for literal, name, spec, conversion in string.Formatter().parse(text):
        if literal:
            parts.append(F.lit(literal))
        if name:
            if conversion:
                raise ValueError("conversions are not supported in templates")
            parts.append(F.format_string(f"%{spec}", columns[name]) if spec and not isinstance(kinds[name], T.StringType) else columns[name].cast("string"))
    some = reduce(lambda a, b: a | b, [columns[n] != "" if isinstance(kinds[n], T.StringType) else F.lit(True) for n in names])
    return F.when(some, F.regexp_replace(F.concat(*parts), r"^\s+|\s+$", "")).otherwise(F.lit(""))


def with_expressions(df: DataFrame, expressions: Mapping[str, str], keep: Sequence[str] = ("row", "segment")) -> DataFrame:
    """``keep`` and a column for each expression, in order; later ones see earlier ones.

    Null texts are ''; '~' counts as '' in templates and expressions, not in
    plain copies; an empty ``label`` becomes '~' in the end.
    """
    fields = {f.name: f.dataType for f in df.schema if f.name not in keep}
    full = {n: F.coalesce(F.col(f"`{n}`"), F.lit("")) if isinstance(t, T.StringType) else F.col(f"`{n}`") for n, t in fields.items()}
    df = df.select(*keep, *[c.alias(f"f_{n}") for n, c in full.items()], *[(F.when(c == "~", "").otherwise(c) if isinstance(fields[n], T.StringType) else c).alias(f"e_{n}") for n, c in full.items()])
    plain, blank, kinds = {n: F.col(f"`f_{n}`") for n in fields}, {n: F.col(f"`e_{n}`") for n in fields}, dict(fields)
    for name, text in expressions.items():
        if template_names(text):
            c = _template(text, blank, kinds)
        elif re.fullmatch(r"[a-zA-Z_][a-zA-Z0-9_]*", text):
            if text not in plain:
                raise ValueError(f"unknown column {text!r}")
            c = plain[text]
        else:
            c = compile_expression(text, blank, {n for n, t in kinds.items() if isinstance(t, T.StringType)})
        df = df.withColumn(f"x_{name}", c)
        blank[name], kinds[name] = F.col(f"`x_{name}`"), df.schema[f"x_{name}"].dataType
    last = lambda n: F.when(F.col(f"`x_{n}`") == "", "~").otherwise(F.col(f"`x_{n}`")) if n == "label" and isinstance(kinds[n], T.StringType) else F.col(f"`x_{n}`")
    return df.select(*keep, *[last(n).alias(n) for n in expressions])


def expand_macros(df: DataFrame, subset: Sequence[str], keep: Sequence[str] = ("row", "segment")) -> list[str]:
    """Column names with macros replaced: ``_all``, ``_all_tags`` (not numeric), and the ``_default`` ones (few distinct values)."""
    fields = {f.name: f.dataType for f in df.schema if f.name not in keep}
    numeric = {n: isinstance(t, T.NumericType) for n, t in fields.items()}
    out = [c for c in subset if c not in MACROS]
    few = set(fields)
    if {"_default", "_default_tags"} & set(subset) and fields:
        r = df.agg(*[F.count_distinct(F.coalesce(F.col(f"`{n}`"), F.lit("")) if isinstance(t, T.StringType) else F.col(f"`{n}`")).alias(f"n{i}") for i, (n, t) in enumerate(fields.items())]).first()
        few = {n for i, n in enumerate(fields) if r[i] <= FEW}
    for macro in MACROS:
        if macro in subset:
            out += [n for n in fields if n not in out and (n in few or "_default" not in macro) and (not macro.endswith("_tags") or not numeric[n])]
    return out


def select_properties(spark: SparkSession, info: Mapping | Document, subset: Sequence[str], scalar_expressions: Mapping[str, str] | None = None, tag_expressions: Mapping[str, str] | None = None) -> dict | Document:
    """A new document with the columns of ``subset`` (names and macros) and computed ones; of the kind that ``info`` is.

    Every step decides row by row: nothing is joined, and only a dict is collected.
    """
    full, tags = segment_table(spark, info, separate=True)
    expressions = {**(scalar_expressions or {}), **(tag_expressions or {})}
    subset = expand_macros(full, subset)
    if bad := set(subset) - set(full.columns):
        raise ValueError(f"invalid segment properties: {', '.join(sorted(bad))}")
    chosen = [c for c in subset if c not in tags] + [c for c in subset if c in tags]
    chosen = [c for c in chosen if c not in expressions]
    if chosen:
        full = full.withColumn(CHOSEN, F.struct(*[F.col(f"`{c}`") for c in chosen]))
    new = with_expressions(full, expressions, ("row", "segment", *([CHOSEN] if chosen else [])))
    both = new.select("row", "segment", *[F.col(f"`{c}`") for c in expressions], *[F.col(CHOSEN)[c].alias(c) for c in chosen])
    doc = segment_document(both, tags=[*(tag_expressions or {}), *[c for c in chosen if c in tags]], order_col="row")
    return doc if isinstance(info, Document) else doc.to_dict()
