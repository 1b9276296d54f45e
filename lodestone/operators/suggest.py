"""Completions of what has been typed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.analysis import fuzzy_distance, local
from lodestone.plans.index import SearchIndex

SUGGESTIONS = "text string, match_type string, frequency long, distance int, document_ids array<string>"
#: With fewer words that begin with the query, similar words are offered too.
ENOUGH = 3


def suggest(index: SearchIndex, query: str, max_results: int | None = None, documents: bool = True) -> DataFrame:
    """(text, match_type, frequency, distance, document_ids): the words that begin with the query, the word itself first, then the more frequent.

    With fewer than three of these, and a query of four characters or more, words a few edits away follow. `document_ids` has all documents with any
    word that begins with the suggestion, for a short word a large part of them; `documents` false leaves it empty. The query is one word; it isn't tokenized.

    Words come from the dictionary, at most twice `max_results` to the driver; only if they are few it is read again for similar ones. Documents come
    from the postings of the words that begin with those found, by literal prefixes.
    """
    q = (query or "").strip().lower()
    most = index.config.suggest_max_results if max_results is None else max_results
    if not q or most <= 0:
        return index.spark.createDataFrame([], SUGGESTIONS)
    word, words = F.col("word"), index.suggest_terms
    begins = words.filter(word.startswith(q)).orderBy(F.desc("frequency"), "word").limit(2 * most).collect()
    found = [(0 if r["word"] == q else 1, -r["frequency"], r["word"], 0) for r in begins]
    d = fuzzy_distance(len(q), index.config.fuzzy.distance)
    if d > 0 and len(found) < ENOUGH:
        near = words.filter(F.char_length("word").between(len(q) - d, len(q) + d) & ~word.startswith(q)).withColumn("distance", F.levenshtein(word, F.lit(q), d)).filter("distance >= 0")
        found += [(2, -r["frequency"], r["word"], r["distance"]) for r in near.orderBy(F.desc("frequency"), "word").limit(most).collect()]
    found = sorted(found)[:most]
    if not found:
        return index.spark.createDataFrame([], SUGGESTIONS)
    rows = [(i, w, ("exact", "prefix", "fuzzy")[k], -n, far) for i, (k, n, w, far) in enumerate(found)]
    top = local(index.spark, "place int, text string, match_type string, frequency long, distance int", rows)
    if not documents:
        return top.orderBy("place").select("text", "match_type", "frequency", "distance", F.array().cast("array<string>").alias("document_ids"))
    other, own = F.col("word"), [w for _, _, w, _ in found]
    has = F.array_compact(F.array(*(F.when(other.startswith(w), F.lit(w)) for w in own)))
    docs = index.suggest_docs.filter(reduce(lambda a, b: a | b, (other.startswith(w) for w in own))).select("doc_id", F.explode(has).alias("text"))
    docs = docs.groupBy("text").agg(F.array_sort(F.collect_set("doc_id")).alias("document_ids"))
    return top.join(docs, "text").orderBy("place").select("text", "match_type", "frequency", "distance", "document_ids")
