"""Text of documents and its tokens, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.config import FieldConfig, TokenizerConfig

#: English words that are not searched, as groups of related ones.
STOPWORDS = frozenset(
    " ".join(
        (
            "he her him his i it its me my our she their them they us we you your",
            "that these this those what which who whom",
            "are be been being did do does had has have is was were",
            "can could dare may might need ought shall should used will would",
            "at by for from in of on to with",
            "a an and both but either neither no nor not or so the yet",
        )
    ).split()
)
SEPARATOR = r"[^\p{L}\p{N}']+"


def local(spark: SparkSession, schema: str, rows: Sequence[Sequence]) -> DataFrame:
    """A frame of a few rows that are part of the plan, so that no task is needed to read them."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    columns = [c.split() for c in schema.split(", ")]
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(columns)], [n for n, _ in columns]))


def number_text(c: Column, kind: T.DataType) -> Column:
    """A number as text: whole ones without a fraction."""
    if not isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return c.cast("string")
    d = c.cast("double")
    return F.when((d == F.floor(d)) & (F.abs(d) < F.lit(1e15)), d.cast("bigint").cast("string")).otherwise(d.cast("string"))


def flatten(c: Column, kind: T.DataType) -> Column:
    """Any value as one text: parts of arrays, maps and structs with spaces between, empty ones left out; null is the empty text."""
    if isinstance(kind, T.StringType):
        out = c
    elif isinstance(kind, T.NumericType):
        out = number_text(c, kind)
    elif isinstance(kind, T.BooleanType):
        out = c.cast("string")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        out = F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    elif isinstance(kind, T.ArrayType):
        out = _joined(F.transform(c, lambda x: flatten(x, kind.elementType)))
    elif isinstance(kind, T.MapType):
        out = _joined(F.transform(F.map_values(c), lambda x: flatten(x, kind.valueType)))
    elif isinstance(kind, T.StructType):
        parts = [flatten(c[f.name], f.dataType) for f in kind.fields]
        out = _joined(F.array(*parts)) if parts else F.lit("")
    else:
        out = F.lit("")
    return F.coalesce(out, F.lit(""))


def _joined(parts: Column) -> Column:
    return F.array_join(F.filter(parts, lambda x: x != ""), " ")


def resolve(schema: T.StructType, path: str, root: Column | None = None) -> tuple[Column, T.DataType | None]:
    """(column, type) at a dotted path, whose numeric parts index arrays; a typeless null if there is nothing."""
    at, kind = root, schema
    for part in path.split("."):
        if isinstance(kind, T.StructType):
            own = next((f for f in kind.fields if f.name == part), None)
            if own is None:
                return F.lit(None), None
            at, kind = (F.col(f"`{part}`") if at is None else at.getField(part)), own.dataType
        elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            at, kind = F.try_element_at(at, F.lit(part)), kind.valueType
        elif isinstance(kind, T.ArrayType) and part.isdigit():
            at, kind = F.get(at, F.lit(int(part))), kind.elementType
        else:
            return F.lit(None), None
    return at, kind


def field_text(df: DataFrame, name: str, field: FieldConfig, computed: bool = True, root: Column | None = None, schema: T.StructType | None = None) -> Column:
    """The text of a field; with `computed` false `extract` is ignored."""
    if computed and field.extract is not None:
        made = field.extract(df) if callable(field.extract) and not isinstance(field.extract, Column) else field.extract
        return F.coalesce(made.cast("string"), F.lit(""))
    c, kind = resolve(schema or df.schema, field.path or name, root)
    return F.lit("") if kind is None else flatten(c, kind)


def tokens(text: Column, config: TokenizerConfig) -> Column:
    """array<string> of the tokens of a text, in order."""
    if config.tokenize is not None:
        return F.coalesce(config.tokenize(text), F.array().cast("array<string>"))
    c = config.normalizer(text) if config.normalizer else text
    parts = F.split(F.lower(c), SEPARATOR)  # empty parts are shorter than any token
    if config.stemmer:
        parts = F.transform(F.filter(parts, lambda t: t != ""), config.stemmer)
    if config.language == "none":
        keep = F.filter(parts, lambda t: F.char_length(t) >= 1)
    else:
        words = STOPWORDS if config.stopwords is None else frozenset(config.stopwords)
        keep = F.filter(parts, lambda t: (F.char_length(t) >= 2) & ~t.isin(*sorted(words)) if words else F.char_length(t) >= 2)
    return F.coalesce(keep, F.array().cast("array<string>"))


def occurrences(tokens_: Column, wanted: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<term, positions>>: where the distinct tokens of an array stand, or those that are wanted; positions ascend."""
    bound = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))  # noqa: E731, what a lambda is given is computed once
    at = F.transform(tokens_, lambda t, i: F.struct(t.alias("term"), i.alias("position")))
    if wanted is not None:
        at = F.filter(at, lambda x: wanted(x["term"]))

    def grouped(s: Column) -> Column:
        begins = F.array_compact(F.transform(s, lambda x, i: F.when((i == 0) | ~F.get(s, i - 1)["term"].eqNullSafe(x["term"]), i)))
        return bound(begins, lambda b: F.transform(b, lambda i, k: F.struct(F.get(s, i)["term"].alias("term"), F.transform(F.slice(s, i + 1, F.coalesce(F.get(b, k + 1), F.size(s)) - i), lambda x: x["position"]).alias("positions"))))

    return bound(F.sort_array(at), grouped)


def query_tokens(spark: SparkSession, text: str, config: TokenizerConfig) -> list[str]:
    """The tokens of a query, the same as those of a text. User functions run as columns over one row."""
    if not text or not text.strip():
        return []
    if config.tokenize or config.normalizer or config.stemmer:
        return list(spark.range(1).select(tokens(F.lit(text), config).alias("t")).first()["t"])
    words, out = frozenset() if config.language == "none" else STOPWORDS if config.stopwords is None else frozenset(config.stopwords), []
    least = 1 if config.language == "none" else 2
    kept = "".join(x if x == "'" or unicodedata.category(x)[0] in "LN" else " " for x in text.lower())
    for t in kept.split(" "):
        if len(t) >= least and t not in words:
            out.append(t)
    return out


def fuzzy_distance(length: int, configured: int) -> int:
    """How many edits a word of so many characters may have."""
    return 0 if length < 4 else min(1 if length < 7 else 2, configured)


def fuzzy_distance_column(length: Column, configured: int) -> Column:
    return F.when(length < 4, 0).when(length < 7, min(1, configured)).otherwise(min(2, configured))


def within_distance(a: Column, b: Column, most: int) -> Column:
    """Whether two texts are at most so many edits apart."""
    return (F.abs(F.char_length(a) - F.char_length(b)) <= most) & (F.levenshtein(a, b, most) >= 0)


def normalize_term(c: Column) -> Column:
    """A term as it is looked up: lower case, without blanks around it."""
    return F.trim(F.lower(c))


def number_of(c: Column, kind: T.DataType) -> Column:
    """A value as a number for range facets: text is parsed (blank text is 0), dates are milliseconds; null for others."""
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.StringType):
        return F.when(F.trim(c) == "", F.lit(0.0)).otherwise(c.try_cast("double"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_millis(c.cast("timestamp")).cast("double")
    return F.lit(None).cast("double")


def date_of(c: Column, kind: T.DataType) -> Column:
    """A value as a timestamp: text is parsed, numbers are milliseconds; null for others."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    if isinstance(kind, T.StringType):
        return c.try_cast("timestamp")
    if isinstance(kind, T.NumericType):
        d = c.cast("double")
        return F.when(F.isnan(d), None).otherwise(F.timestamp_millis(d.try_cast("bigint")))
    return F.lit(None).cast("timestamp")


def truncate(c: Column, interval: str) -> Column:
    """The beginning of the day, week (from Sunday), month or year."""
    if interval == "week":
        return F.date_sub(c.cast("date"), F.dayofweek(c) - 1).cast("timestamp")
    if interval not in ("day", "month", "year"):
        raise ValueError(f"unknown interval {interval!r}")
    return F.date_trunc(interval, c)
