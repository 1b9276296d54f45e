"""Ranked search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from time import perf_counter
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.analysis import field_text
from lodestone.operators.facets import facet
from lodestone.operators.filters import compile_filter
from lodestone.operators.highlight import highlight
from lodestone.operators.scoring import MATCH_TYPES, boosted, match_any, normalised, phrase_docs, scores
from lodestone.operators.sorting import page
from lodestone.plans.index import SearchIndex

#: Rows of a page up to which it is broadcast to the documents.
PAGE_BROADCAST = 10_000
HITS = "doc_id string, score double, raw_score double, match_type string"


@dataclass
class SearchResult:
    """What a search gives: `hits` (document, doc_id, score, raw_score, match_type, highlights), lazily, and the rest on demand."""

    hits: DataFrame
    candidates: DataFrame
    query: str
    limit: int | None
    offset: int
    facets: dict[str, DataFrame] | None = None
    started: float = field(default_factory=perf_counter)
    _total: int | None = None

    def total(self) -> int:
        """How many documents match, on all pages."""
        if self._total is None:
            self._total = self.candidates.count()
        return self._total

    def has_more(self) -> bool:
        return self.limit is not None and self.offset + self.limit < self.total()

    def to_dict(self) -> dict[str, Any]:
        """Everything, collected: the page, the total, the facets and the time since the search was asked for in milliseconds."""
        out = {"hits": [r.asDict(True) for r in self.hits.collect()], "total": self.total(), "query": self.query}
        out["pagination"] = {"limit": self.limit, "offset": self.offset, "has_more": self.has_more()}
        if self.facets is not None:
            out["facets"] = {n: [r.asDict() for r in f.collect()] for n, f in self.facets.items()}
        return out | {"took": (perf_counter() - self.started) * 1000}


def score_order(*more: Column) -> list[Column]:
    """Best score first, as far as it doesn't depend on the order of additions; equal ones by doc_id."""
    return [F.desc(F.round("score", 12)), *more, F.col("doc_id")]


def ranked(index: SearchIndex, tokens: Sequence[str], fields: Sequence[str], matching: DataFrame | None, boost: bool) -> DataFrame:
    """(doc_id, raw_score, kind, matched_tokens, score) of every document that matches. Statistics are those of the whole index, whatever the filter."""
    c = index.config
    # terms are looked up first: see postings_of()
    postings = index.postings_of(lambda t: match_any(t, tokens, c.fuzzy.distance), fields)
    raw = scores(postings, tokens, fields, {n: f.weight for n, f in c.fields.items()}, index.statistics(), c.k1, c.b, c.fuzzy.distance)
    if matching is not None:
        raw = raw.join(matching, "doc_id", "left_semi")
    if boost and len(tokens) > 1:
        raw = boosted(raw, phrase_docs(index.postings_named(tokens, fields), tokens, fields))
    return normalised(raw)


def highlights(index: SearchIndex, fields: Sequence[str]) -> Column:
    """array<struct<field, snippet, matched_tokens>> of the searched fields in which a matched token is found. Computed fields have none."""
    schema, parts = index.doc_schema, []
    for n in fields:
        text = field_text(index.docs, n, index.config.fields[n], computed=False, root=F.col("doc"), schema=schema)
        h = highlight(text, F.col("matched_tokens"))
        parts.append(F.struct(F.lit(n).alias("field"), h["snippet"].alias("snippet"), h["matched_tokens"].alias("matched_tokens")))
    return F.filter(F.array(*parts), lambda x: F.size(x["matched_tokens"]) > 0)


def _nothing(index: SearchIndex, query: str, limit: int | None, offset: int, facets: dict[str, DataFrame] | None) -> SearchResult:
    none = index.docs.filter(F.lit(False)).select(F.col("doc").alias("document"), "doc_id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("raw_score"), F.lit(None).cast("string").alias("match_type"))
    return SearchResult(none, none.select("doc_id"), query, limit, offset, facets, _total=0)


def search(
    index: SearchIndex,
    query: str,
    limit: int | None = 10,
    offset: int = 0,
    filter: Any = None,
    fields: Sequence[str] | None = None,
    highlight: bool = True,
    min_score: float = 0.0,
    boost_exact: bool = True,
    sort: Mapping | None = None,
    facets: Mapping[str, Mapping] | None = None,
) -> SearchResult:
    """Documents that match any token of a query, best first, or in the order of `sort`.

    `filter` decides which documents are hits and are counted by `facets`, which don't depend on the query. `fields` restricts the searched fields;
    unknown names are dropped. A query without tokens gives nothing, not even facets. `limit` None gives all hits.
    """
    if offset < 0 or (limit is not None and limit < 0):
        raise ValueError("limit and offset can't be negative")
    started = perf_counter()
    tokens = index.query_tokens(query)
    if not tokens:
        return _nothing(index, query.strip(), limit, offset, None)
    own = list(index.config.fields) if fields is None else [f for f in fields if f in index.config.fields]
    passing = index.docs if filter is None else index.docs.filter(compile_filter(index.doc_schema, filter, root=F.col("doc")))
    counted = {n: facet(passing.select("doc.*"), n, f) for n, f in facets.items()} if facets else None
    if not own or index.statistics()[""] == 0:
        return _nothing(index, query, limit, offset, counted)
    every = ranked(index, tokens, own, None if filter is None else passing.select("doc_id"), boost_exact)
    kept = every.filter(F.col("score") >= min_score)
    if sort:
        in_order = [index.order(sort), *score_order()]
        rows = page(kept.join(index.docs.select("doc_id", "seq", "doc"), "doc_id").orderBy(*in_order), limit, offset)
    else:
        top = page(kept.orderBy(*score_order()), limit, offset)
        few = limit is not None and limit <= PAGE_BROADCAST
        rows = index.docs.select("doc_id", "doc").join(F.broadcast(top) if few else top, "doc_id")
        in_order = score_order()
    hits = shown(index, rows.orderBy(*in_order), own if highlight else None)
    return SearchResult(hits, kept.select("doc_id"), query, limit, offset, counted, started)


def shown(index: SearchIndex, rows: DataFrame, fields: Sequence[str] | None, *more: str) -> DataFrame:
    """(document, doc_id, score, raw_score, match_type, matched_tokens) of ranked rows with their documents, and the highlights in `fields`, if given."""
    kind = F.get(F.array(*(F.lit(m) for m in MATCH_TYPES)), F.col("kind"))
    marked = [highlights(index, fields).alias("highlights")] if fields is not None else []
    return rows.select(*more, F.col("doc").alias("document"), "doc_id", "score", "raw_score", kind.alias("match_type"), "matched_tokens", *marked)
