"""Many queries in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.analysis import fuzzy_distance_column, tokens
from lodestone.operators.scoring import MATCH_TYPES, bm25
from lodestone.plans.index import SearchIndex


#: Terms of a batch's queries, with a row for each query, up to which they come to the driver and are broadcast: some 10 MB.
BATCH_TERMS = 100_000


def _prefixes(c):
    return F.transform(F.sequence(F.lit(2), F.char_length(c)), lambda i: F.substring(c, F.lit(1), i))


def _cut(length, d: int, i):
    """Where the i-th of d + 1 nearly equal parts of so many characters begins."""
    return F.floor(i * length / (d + 1)).cast("int")


def _segments(c, d: int):
    """The parts of a text, each with its number and the length of the text."""
    n = F.char_length(c)
    return F.transform(F.sequence(F.lit(0), F.lit(d)), lambda i: F.struct(n.alias("n"), i.alias("i"), F.substring(c, _cut(n, d, i) + 1, _cut(n, d, i + 1) - _cut(n, d, i)).alias("part")))


def _windows(c, d: int):
    """What a text within `d` edits of this one can have as parts: one of its parts stands here unchanged, moved by `d` places at most."""
    n = F.char_length(c)

    def of(length):
        def part(i):
            size = _cut(length, d, i + 1) - _cut(length, d, i)
            starts = F.filter(F.transform(F.sequence(F.lit(-d), F.lit(d)), lambda s: _cut(length, d, i) + s), lambda x: (x >= 0) & (x + size <= n))
            return F.transform(starts, lambda x: F.struct(length.alias("n"), i.alias("i"), F.substring(c, x + 1, size).alias("part")))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(d)), part))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.greatest(F.lit(1), n - d), n + d), of)))


def expansions(index: SearchIndex, wanted: DataFrame) -> DataFrame:
    """(field, term, df, token, kind) of all terms that the distinct tokens of `wanted` (token) match, by equi-joins only.

    Prefixes join on the prefixes of terms. For fuzzy matches a term is cut into one part more than the edits allowed; one part at least is
    unchanged, and joins with the same characters of the token near its place.
    """
    distance = index.config.fuzzy.distance
    terms = index.dictionary.select("field", "term", "term_len", "df")
    exact = terms.join(wanted, F.col("term") == F.col("token")).select("field", "term", "df", "token", F.lit(0).alias("kind"))
    begins = terms.filter("term_len > 2").withColumn("key", F.explode(F.slice(_prefixes(F.col("term")), 1, F.col("term_len") - 2)))
    prefix = begins.join(wanted, F.col("key") == F.col("token")).select("field", "term", "df", "token", F.lit(1).alias("kind"))
    out = exact.unionByName(prefix)
    if distance > 0:
        for d in range(1, min(distance, 2) + 1):
            asked = wanted.filter((fuzzy_distance_column(F.char_length("token"), distance) == d)).withColumn("key", F.explode(_windows(F.col("token"), d)))
            near = terms.filter(F.col("term_len") >= 4 - d).withColumn("key", F.explode(_segments(F.col("term"), d))).join(asked, "key")
            near = near.filter((F.col("term") != F.col("token")) & ~F.col("term").startswith(F.col("token")) & (F.levenshtein("term", "token", d) >= 0))
            out = out.unionByName(near.select("field", "term", "df", "token", F.lit(2).alias("kind")).distinct())
    return out


def search_batch(index: SearchIndex, queries: DataFrame, limit: int = 10, fields: Sequence[str] | None = None, min_score: float = 0.0) -> DataFrame:
    """(query_id, doc_id, score, raw_score, match_type, rank) of the best hits of every query (query_id, query), without phrase boost.

    Scores are those that search() gives one by one with boost_exact=False. The terms found are few beside the postings: up to BATCH_TERMS of them are
    broadcast, so that postings of others are dropped where they are read and none are exchanged for the join.
    """
    c = index.config
    own = list(c.fields) if fields is None else [f for f in fields if f in c.fields]
    times = index.spark.createDataFrame([(f, float(c.fields[f].weight * own.count(f)), float(index.statistics()[f])) for f in dict.fromkeys(own)], "field string, weight double, average double")
    asked = queries.select("query_id", F.explode(tokens(F.col("query"), c.tokenizer)).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("n"))
    matched = asked.join(expansions(index, asked.select("token").distinct()), "token")
    rows = matched.limit(BATCH_TERMS + 1).collect()
    if len(rows) <= BATCH_TERMS:
        matched = F.broadcast(index.spark.createDataFrame(rows, matched.schema))
    # one row for each field
    hits = index.postings.select("field", "term", "doc_id", "tf", "len").join(matched, ["field", "term"]).join(F.broadcast(times), "field")
    score = bm25(F.col("tf"), F.col("df"), F.col("len"), index.statistics()[""], F.col("average"), c.k1, c.b) * F.col("weight") * F.col("n")
    raw = hits.groupBy("query_id", "doc_id").agg(F.sum(score).alias("raw_score"), F.min("kind").alias("kind"))
    top = F.max("raw_score").over(W.partitionBy("query_id"))
    scored = raw.withColumn("top", top).withColumn("score", F.when(F.col("top") > 0, F.col("raw_score") / F.col("top")).otherwise(F.col("raw_score"))).filter(F.col("score") >= min_score)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "doc_id"))
    kind = F.get(F.array(*(F.lit(m) for m in MATCH_TYPES)), F.col("kind"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= limit).select("query_id", "doc_id", "score", "raw_score", kind.alias("match_type"), "rank")
