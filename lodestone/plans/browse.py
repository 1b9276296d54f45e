"""Documents without a query: filtered, sorted, paged."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.filters import compile_filter
from lodestone.operators.sorting import page
from lodestone.plans.index import SearchIndex


@dataclass
class BrowseResult:
    documents: DataFrame
    candidates: DataFrame
    limit: int | None
    offset: int

    def total(self) -> int:
        return self.candidates.count()

    def has_more(self) -> bool:
        return self.limit is not None and self.offset + self.limit < self.total()


def browse(index: SearchIndex, filter: Any = None, sort: Mapping | None = None, limit: int | None = 10, offset: int = 0) -> BrowseResult:
    """The documents that pass `filter` in the order of `sort`, or in that of the index; ties by doc_id."""
    own = index.docs.select("doc_id", "seq", "doc")
    if filter is not None:
        own = own.filter(compile_filter(index.doc_schema, filter, root=F.col("doc")))
    by = [index.order(sort), F.col("doc_id")] if sort else [F.col("seq")]
    return BrowseResult(page(own.orderBy(*by), limit, offset).select("doc.*"), own, limit, offset)
