"""Several named indexes, and search over all of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.filters import compile_filter
from lodestone.operators.sorting import page
from lodestone.plans.index import SearchIndex
from lodestone.plans.search import PAGE_BROADCAST, ranked, shown


@dataclass
class SearchAllResult:
    """`hits` (index, document as JSON, doc_id, score, raw_score, match_type, highlights) of all indexes."""

    hits: DataFrame
    candidates: DataFrame
    query: str
    limit: int | None
    offset: int

    def total(self) -> int:
        return self.candidates.count()

    def per_index(self) -> dict[str, int]:
        """Hits of each index."""
        return {r["index"]: r["n"] for r in self.candidates.groupBy("index").agg(F.count("*").alias("n")).collect()}


class IndexManager:
    """Indexes by name."""

    def __init__(self) -> None:
        self._indexes: dict[str, SearchIndex] = {}

    def create_index(self, name: str, index: SearchIndex) -> SearchIndex:
        if not name or not name.strip():
            raise ValueError("an index needs a name")
        if name in self._indexes:
            raise ValueError(f"there is an index {name!r} already")
        self._indexes[name] = index
        return index

    def get_index(self, name: str) -> SearchIndex | None:
        return self._indexes.get(name)

    def remove_index(self, name: str) -> None:
        self._indexes.pop(name, None)

    def _of(self, name: str) -> SearchIndex:
        if name not in self._indexes:
            raise KeyError(f"there is no index {name!r}")
        return self._indexes[name]

    def names(self) -> list[str]:
        return list(self._indexes)

    def add_many(self, name: str, df: DataFrame) -> None:
        self._indexes[name] = self._of(name).add_many(df)

    add = add_many

    def remove(self, name: str, *ids: Any) -> None:
        self._indexes[name] = self._of(name).remove(*ids)

    def search(self, name: str, query: str, **options: Any):
        return self._of(name).search(query, **options)

    def suggest(self, name: str, query: str) -> DataFrame:
        return self._of(name).suggest(query)

    def stats(self, name: str) -> dict[str, Any]:
        return self._of(name).stats()

    def browse(self, name: str, **options: Any):
        return self._of(name).browse(**options)

    def search_all(self, query: str, indexes: Sequence[str] | Mapping[str, float] | None = None, limit: int | None = 10, offset: int = 0, filter: Any = None, highlight: bool = True) -> SearchAllResult:
        """The hits of several indexes in one order: each one's scores by its weight, over the highest of these if that is more than 1.

        Without `indexes` all take part with weight 1. Names that repeat give their hits again. Documents are JSON, as their columns differ.
        """
        if offset < 0 or (limit is not None and limit < 0):
            raise ValueError("limit and offset can't be negative")
        weights = [(n, 1.0) for n in self._indexes] if indexes is None else [(n, float(w)) for n, w in indexes.items()] if isinstance(indexes, Mapping) else [(n, 1.0) for n in indexes]
        parts = []
        for i, (n, w) in enumerate(weights):
            index = self._of(n)
            tokens = index.query_tokens(query)
            if tokens and index.statistics()[""]:
                passing = None if filter is None else index.docs.filter(compile_filter(index.doc_schema, filter, root=F.col("doc"))).select("doc_id")
                parts.append(ranked(index, tokens, list(index.config.fields), passing, True).withColumns({"index": F.lit(n), "ord": F.lit(i), "score": F.col("score") * w}))
        if not parts:
            spark = SparkSession.active()
            none = spark.createDataFrame([], "index string, document string, doc_id string, score double, raw_score double, match_type string")
            return SearchAllResult(none, none.select("index", "doc_id"), query, limit, offset)
        # ids and scores are ranked first; documents and highlights are made for the page alone
        every = reduce(lambda a, b: a.unionByName(b), parts)
        top = every.agg(F.greatest(F.lit(1.0), F.max("score")).alias("top"))
        scored = every.crossJoin(F.broadcast(top)).withColumn("score", F.col("score") / F.col("top")).drop("top")  # one row
        in_order = [F.desc(F.round("score", 12)), "ord", "doc_id"]
        best = page(scored.orderBy(*in_order), limit, offset)
        few = limit is not None and limit <= PAGE_BROADCAST
        hits = []
        for i, (n, _) in enumerate(weights):
            index = self._of(n)
            own = best.filter(F.col("ord") == i)
            rows = shown(index, index.docs.select("doc_id", "doc").join(F.broadcast(own) if few else own, "doc_id"), list(index.config.fields) if highlight else None, "index", "ord")
            hits.append(rows.withColumn("document", F.to_json("document", {"ignoreNullFields": "false"})).drop("matched_tokens"))
        rows = reduce(lambda a, b: a.unionByName(b), hits).orderBy(*in_order)
        return SearchAllResult(rows.drop("ord"), every.select("index", "doc_id"), query, limit, offset)
