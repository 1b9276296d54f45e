"""Counts over documents: terms, ranges, dates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.analysis import date_of, number_of, number_text, resolve, truncate


def terms_facet(df: DataFrame, field: str, size: int | None = 10) -> DataFrame:
    """(key, count) of the most frequent texts or numbers, parts of arrays counted each; equal counts in order of key. `size` None gives all."""
    c, kind = resolve(df.schema, field)
    if isinstance(kind, T.ArrayType):
        values, kind = df.select(F.explode(c).alias("v")), kind.elementType
    else:
        values = df.select(c.alias("v"))
    if not isinstance(kind, (T.StringType, T.NumericType)):
        return df.sparkSession.createDataFrame([], "key string, count long")
    counted = values.filter(F.col("v").isNotNull()).groupBy("v").agg(F.count("*").alias("count"))
    key = number_text(F.col("v"), kind) if isinstance(kind, T.NumericType) else F.col("v")
    out = counted.select(key.alias("key"), "count").orderBy(F.desc("count"), "key")
    return out if size is None else out.limit(size)


def range_facet(df: DataFrame, field: str, ranges: list[Mapping]) -> DataFrame:
    """(ord, key, count) of ranges {"label", "from", "to"}, both ends included, each by itself, in one pass."""
    spark = df.sparkSession
    if not ranges:
        return spark.createDataFrame([], "ord int, key string, count long")
    c, kind = resolve(df.schema, field)
    n = F.lit(None).cast("double") if kind is None else number_of(c, kind)
    values = df.select(F.when(~F.isnan(n), n).alias("n"))
    sums = []
    for i, r in enumerate(ranges):
        ok = F.col("n").isNotNull()
        ok = ok & (F.col("n") >= F.lit(float(r["from"]))) if r.get("from") is not None else ok
        ok = ok & (F.col("n") <= F.lit(float(r["to"]))) if r.get("to") is not None else ok
        sums.append(F.count_if(ok).alias(f"c{i}"))
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(str(r["label"])).alias("key"), F.col(f"c{i}").alias("count")) for i, r in enumerate(ranges)))
    return values.agg(*sums).select(F.inline(rows)).orderBy("ord")


def date_facet(df: DataFrame, field: str, interval: str = "day") -> DataFrame:
    """(key, count) of the days, weeks (from Sunday), months or years that occur, as ISO texts in UTC, in order."""
    c, kind = resolve(df.schema, field)
    at = F.lit(None).cast("timestamp") if kind is None else date_of(c, kind)
    key = F.date_format(truncate(F.col("at"), interval), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return df.select(at.alias("at")).filter("at is not null").groupBy(key.alias("key")).agg(F.count("*").alias("count")).orderBy("key")


def facet(df: DataFrame, field: str, config: Mapping) -> DataFrame:
    """The facet {"type": "terms" | "range" | "date_histogram", ...} of a field."""
    kind = config.get("type", "terms")
    if kind == "terms":
        return terms_facet(df, field, config.get("size", 10))
    if kind == "range":
        return range_facet(df, field, list(config.get("ranges") or []))
    if kind == "date_histogram":
        return date_facet(df, field, config.get("interval", "day"))
    raise ValueError(f"unknown facet type {kind!r}")
