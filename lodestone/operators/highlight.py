"""Snippets of text with the found words marked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BEFORE, LENGTH = 30, 160


def quoted(t: Column) -> Column:
    """A regular expression that matches the text `t` itself, in any case."""
    return F.concat(F.lit("(?iu)\\Q"), F.replace(t, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def highlight(value: Column, tokens: Column, length: int = LENGTH) -> Column:
    """struct<snippet, matched_tokens> of a text and an array of tokens.

    The snippet begins 30 characters before the first token found as a substring and has `length` characters after that beginning, an ellipsis
    where it is cut. Tokens are marked one after the other, the longest first, also inside marks made before. Without a found
    token it is the first `length` characters.
    """
    low = F.lower(value)
    found = F.filter(tokens, lambda t: F.instr(low, t) > 0)
    first = F.array_min(F.transform(found, lambda t: F.instr(low, t))) - 1
    begin = F.greatest(F.lit(0), first - BEFORE)
    n = F.char_length(value)
    end = F.least(n, begin + length)
    snippet = F.concat(F.when(begin > 0, F.lit("…")).otherwise(F.lit("")), F.substring(value, begin + 1, end - begin), F.when(end < n, F.lit("…")).otherwise(F.lit("")))
    ranked = F.transform(found, lambda t, i: F.struct((-F.char_length(t)).alias("l"), i.alias("i"), t.alias("t")))
    marked = F.aggregate(F.transform(F.array_sort(ranked), lambda x: x["t"]), snippet, lambda text, t: F.regexp_replace(text, quoted(t), F.lit("<mark>$0</mark>")))
    some = F.size(found) > 0
    return F.struct(F.when(some, marked).otherwise(F.substring(value, 1, length)).alias("snippet"), F.when(some, found).otherwise(F.array().cast("array<string>")).alias("matched_tokens"))
