"""Order by a field, and pages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.analysis import date_of, resolve


#: Texts that are numbers as a whole.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _number(c: Column) -> Column:
    """A text as a number; a blank one is 0."""
    return F.when(F.trim(c) == "", F.lit(0.0)).when(c.rlike(NUMBER), c.try_cast("double"))


def may_be_numbers(schema: T.StructType, sort: Mapping, root: Column | None = None) -> bool:
    """Whether the values must be looked at to tell how to order by them: texts, ordered as "auto"."""
    return (sort.get("type") or "auto") == "auto" and isinstance(resolve(schema, sort["field"], root)[1], T.StringType)


def are_numbers(df: DataFrame, field: str, root: Column | None = None, schema: T.StructType | None = None) -> bool:
    """Whether all texts that there are at `field` are numbers, and at least one is not blank; one aggregation."""
    c = resolve(schema or df.schema, field, root)[0]
    got = df.agg(F.bool_and(_number(c).isNotNull() | c.isNull()).alias("all"), F.bool_or(F.trim(c) != "").alias("some")).first()
    return bool(got["all"] and got["some"])


def sort_key(schema: T.StructType, field: str, kind: str = "auto", root: Column | None = None, numbers: bool = False) -> Column:
    """What documents are ordered by, null where they have no such value.

    `kind` is "date", "number", "string" (collated by the rules of Unicode) or "auto": numbers, booleans and dates by themselves, text collated, or as
    numbers if `numbers` says that all of it are_numbers().
    """
    c, own = resolve(schema, field, root)
    if own is None:
        return F.lit(None).cast("double")
    if kind == "date":
        return date_of(c, own)
    if kind == "number":
        if isinstance(own, T.StringType):
            return F.when(F.trim(c) == "", F.lit(0.0)).otherwise(c.try_cast("double"))
        return c.cast("double") if isinstance(own, (T.NumericType, T.BooleanType)) else F.lit(None).cast("double")
    if kind == "auto" and isinstance(own, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("double") if isinstance(own, (T.NumericType, T.BooleanType)) else c
    if kind == "auto" and numbers and isinstance(own, T.StringType):
        return _number(c)
    if kind not in ("auto", "string"):
        raise ValueError(f"unknown sort type {kind!r}")
    return F.collate(c.cast("string"), "UNICODE") if isinstance(own, (T.StringType, T.NumericType, T.BooleanType)) else F.lit(None).cast("string")


def order(schema: T.StructType, sort: Mapping, root: Column | None = None, numbers: bool = False) -> Column:
    """The order that {"field", "direction", "type"} asks for; documents without a value come last either way."""
    key = sort_key(schema, sort["field"], sort.get("type") or "auto", root, numbers)
    own = resolve(schema, sort["field"], root)[1]
    if isinstance(own, (T.DoubleType, T.FloatType)) and sort.get("type") != "date":
        key = F.when(~F.isnan(key), key) if sort.get("type") in (None, "auto", "number") else key
    direction = sort.get("direction") or "asc"
    if direction not in ("asc", "desc"):
        raise ValueError(f"unknown direction {direction!r}")
    return key.asc_nulls_last() if direction == "asc" else key.desc_nulls_last()


def sort_documents(df: DataFrame, sort: Mapping, *ties: str) -> DataFrame:
    """`df` in the order of `sort`; texts ordered as "auto" are looked at first, in one job."""
    numbers = may_be_numbers(df.schema, sort) and are_numbers(df, sort["field"])
    return df.orderBy(order(df.schema, sort, numbers=numbers), *ties)


def page(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """A page of an ordered frame; no limit gives everything from the offset on."""
    if offset < 0 or (limit is not None and limit < 0):
        raise ValueError("limit and offset can't be negative")
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)
