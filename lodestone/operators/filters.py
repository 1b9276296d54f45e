"""The filter language, compiled to columns.

A filter is {"field", "operator", "value"}, or a group {"AND": [...]}, {"OR": [...]} or {"NOT": ...}. Its logic has two values: a comparison with a missing
value is false, so that its negation is true. Missing and null are the same.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping
from functools import reduce
from numbers import Number
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.analysis import resolve

ORDERED = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


def is_number(v: Any) -> bool:
    return isinstance(v, Number) and not isinstance(v, (bool, complex))


def _fits(v: Any, kind: T.DataType) -> bool:
    """Whether a literal has the type of a column, so that they can be equal at all."""
    if isinstance(v, bool):
        return isinstance(kind, T.BooleanType)
    if is_number(v):
        return isinstance(kind, T.NumericType)
    return isinstance(v, str) and isinstance(kind, T.StringType)


def _nan(v: Any) -> bool:
    return isinstance(v, float) and math.isnan(v)


def _is_nan(c: Column, kind: T.DataType) -> Column:
    return F.isnan(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.lit(False)


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _member(c: Column, kind: T.DataType | None, values: list) -> Column:
    """Null-free `in`, where NaN equals itself."""
    own = [v for v in values if kind is not None and v is not None and _fits(v, kind)]
    plain = [v for v in own if not _nan(v)]
    out = _sure(c.isin(*plain)) if plain else F.lit(False)
    if len(plain) < len(own):
        out = out | _sure(_is_nan(c, kind))
    return out | c.isNull() if None in values else out


def _clause(schema: T.StructType, f: Mapping, exact: bool, root: Column | None) -> Column:
    """`exact` leaves comparisons null for nulls, which rejects rows at the top level and can be pushed down to files."""
    c, kind = resolve(schema, str(f.get("field", "")), root)
    op, v = f.get("operator"), f.get("value")
    weigh = (lambda x: x) if exact else _sure
    if op == "exists":
        return c.isNotNull()
    if op in ("eq", "neq"):
        if v is None:
            return c.isNull() if op == "eq" else c.isNotNull()
        if kind is None or not _fits(v, kind) or _nan(v):
            return F.lit(op == "neq")
        if op == "neq":
            return ~c.eqNullSafe(F.lit(v))
        return c == F.lit(v) if exact else c.eqNullSafe(F.lit(v))
    if op in ORDERED:
        if not isinstance(kind, T.NumericType) or not is_number(v) or _nan(v):
            return F.lit(False)
        out = getattr(c, ORDERED[op])(F.lit(v))
        return weigh(out & ~F.isnan(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else out)
    if op == "range":
        if not isinstance(kind, T.NumericType) or not isinstance(v, (list, tuple)) or len(v) != 2:
            return F.lit(False)
        try:
            lo, hi = (0.0 if x is None or x == "" else float(x) for x in v)
        except (TypeError, ValueError):
            return F.lit(False)
        if math.isnan(lo) or math.isnan(hi):
            return F.lit(False)
        out = (c >= F.lit(lo)) & (c <= F.lit(hi))
        return weigh(out & ~F.isnan(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else out)
    if op in ("in", "nin"):
        if not isinstance(v, (list, tuple, set, frozenset)):
            return F.lit(False)
        inside = _member(c, kind, list(v))
        return inside if op == "in" else ~inside
    if op in ("contains", "startsWith"):
        if not isinstance(kind, T.StringType) or not isinstance(v, str):
            return F.lit(False)
        low = F.lower(c)
        return weigh(low.contains(v.lower()) if op == "contains" else low.startswith(v.lower()))
    warnings.warn(f"unknown filter operator {op!r} matches nothing", stacklevel=2)
    return F.lit(False)


def compile_filter(schema: T.StructType, f: Any, exact: bool = True, root: Column | None = None) -> Column:
    """A filter as a boolean column over rows of `schema`. Of several keys of a group the first of AND, OR, NOT counts; a filter that says nothing is true."""
    if not isinstance(f, Mapping) or not f:
        return F.lit(True)
    if "operator" in f and "field" in f:
        return _clause(schema, f, exact, root)
    keys = [k for k in ("AND", "OR", "NOT") if f.get(k) is not None]
    if len(keys) > 1:
        warnings.warn(f"of {keys} in one filter group only {keys[0]} counts", stacklevel=2)
    if not keys:
        return F.lit(True)
    if keys[0] == "AND":
        return reduce(lambda a, b: a & b, (compile_filter(schema, x, exact, root) for x in f["AND"]), F.lit(True)) if f["AND"] else F.lit(True)
    if keys[0] == "OR":
        return reduce(lambda a, b: a | b, (compile_filter(schema, x, False, root) for x in f["OR"])) if f["OR"] else F.lit(False)
    return ~compile_filter(schema, f["NOT"], False, root)


def filter_documents(df: DataFrame, f: Any) -> DataFrame:
    """The rows that a filter lets through."""
    return df.filter(compile_filter(df.schema, f))
