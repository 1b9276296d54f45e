"""Pages rejected by the terms in their URLs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.url_terms import soft_terms, strict_terms

#: Terms up to which a table of them is taken to the driver and sent to every task: some 100 MB as an automaton.
MOST_TERMS = 1_000_000


@dataclass(frozen=True)
class Vocabulary:
    """Strict and weighted soft terms in lower case. A URL is rejected with one strict term, or with `distinct` soft ones that weigh `weight` together."""

    strict: tuple[str, ...] = field(default_factory=strict_terms)
    soft: Mapping[str, float] = field(default_factory=soft_terms)
    distinct: int = 2
    weight: float = 1.5

    @classmethod
    def of(cls, terms: DataFrame, distinct: int = 2, weight: float = 1.5) -> Vocabulary:
        """The terms of a table (term, weight), in lower case; those with a null weight are strict. Null and empty terms are left out; of weights of one term the largest counts."""
        own = terms.select(F.lower("term").alias("term"), F.col("weight").cast("double").alias("weight")).filter("term <> ''").groupBy("term", F.col("weight").isNull().alias("hard")).agg(F.max("weight").alias("weight"))
        rows = own.limit(MOST_TERMS + 1).collect()
        if len(rows) > MOST_TERMS:
            raise ValueError(f"more than {MOST_TERMS} terms")
        return cls(tuple(sorted(r["term"] for r in rows if r["hard"])), {r["term"]: r["weight"] for r in sorted(rows) if not r["hard"]}, distinct, weight)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for t in sorted({*self.strict, *self.soft} - {""}):
            found.add_word(t, t)
        found.make_automaton()
        return found


_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(automaton: ahocorasick.Automaton, url: str) -> set[str]:
    """The distinct terms of a URL in lower case that no letter or digit touches on either side."""
    if not len(automaton):
        return set()
    return {t for end, t in automaton.iter(url) if (end + 1 == len(url) or url[end + 1] not in _WORD) and (end < len(t) or url[end - len(t)] not in _WORD)}


def _scan(told):
    def run(batches):
        v = told.value
        found, strict = v.automaton(), frozenset(v.strict)
        for batch in batches:
            rows = [terms(found, u) for u in batch.column(1).to_pylist()]
            hard = np.array([len(r & strict) for r in rows], np.int32)
            soft = [sorted(t for t in r if t in v.soft) for r in rows]
            many = np.array([len(s) for s in soft], np.int32)
            weight = np.array([sum(v.soft[t] for t in s) for s in soft], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hard), pa.array(many), pa.array(weight), pa.array((hard > 0) | ((many >= v.distinct) & (weight >= v.weight)))], ["page_id", "strict_terms", "soft_terms", "soft_weight", "rejected"])

    return run


def url_filter(pages: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(page_id, strict_terms, soft_terms, soft_weight, rejected) of every page.

    An Aho-Corasick automaton finds all terms, overlapping ones too, in the URL (case is ignored within ASCII); a term counts once, and only where
    no ASCII letter or digit stands right before or after it. A term in both lists counts in both. Null and empty URLs have no term and
    stay. Rows that repeat are told each; a null page_id stays null. Other columns are not read.
    """
    told = pages.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary())  # MOST_TERMS at most if it is from a table
    url = F.translate(F.coalesce(F.col("url").cast("string"), F.lit("")), _UPPER, _LOWER)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url")).mapInArrow(_scan(told), "page_id long, strict_terms int, soft_terms int, soft_weight double, rejected boolean")


def oracle_sql(v: Vocabulary | None = None) -> str:
    """The same in SQL, a row for each term; terms have no other special characters than '-', '_' and '.'."""
    v = v or Vocabulary()
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    rows = ", ".join([f"({quoted(t)}, true, 0.0)" for t in v.strict] + [f"({quoted(t)}, false, {w})" for t, w in v.soft.items()])
    return f"""
with terms(t, hard, w) as (values {rows}),
pages_ as (select page_id, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') as u, row_number() over () as r from pages),
maybe as materialized (select distinct u, t, hard, w from pages_ join terms on contains(u, t)),
hits as (select u, count(*) filter (hard) as hard, count(*) filter (not hard) as soft, sum(w::double) as weight from maybe where regexp_matches(u, '(^|[^a-z0-9])' || replace(t, '.', '[.]') || '($|[^a-z0-9])') group by u)
select page_id, coalesce(hard, 0)::int as strict_terms, coalesce(soft, 0)::int as soft_terms, coalesce(weight, 0) as soft_weight, coalesce(hard, 0) > 0 or (coalesce(soft, 0) >= {v.distinct} and coalesce(weight, 0) >= {v.weight}) as rejected
from pages_ left join hits using (u)
"""
