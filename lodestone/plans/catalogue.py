"""The registered queries over the reference operators, and the SQL each must agree with."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.config import FieldConfig, IndexConfig, TokenizerConfig
from lodestone.functions.analysis import STOPWORDS, date_of, field_text, fuzzy_distance, fuzzy_distance_column, normalize_term, query_tokens, tokens, within_distance
from lodestone.operators import scoring
from lodestone.operators.facets import date_facet, range_facet, terms_facet
from lodestone.operators.filters import filter_documents
from lodestone.operators.highlight import quoted
from lodestone.operators.sorting import sort_documents
from lodestone.plans.index import SearchIndex
from lodestone.plans.manager import IndexManager
from lodestone.plans.search import ranked
from lodestone.sources import storage
from lodestone.streaming.upserts import start_upserts

Query = Callable[[SparkSession, str], DataFrame]

CORPORA: dict[str, tuple[str, IndexConfig]] = {
    "D": ("documents", IndexConfig.of({"text": FieldConfig(), "source": FieldConfig(weight=2.0)}, id_col="doc_id")),
    "P": ("part", IndexConfig.of({"p_name": FieldConfig(weight=3.0), "p_brand": FieldConfig(weight=2.0), "p_type": FieldConfig()}, id_col="p_partkey")),
}
IDS = {"D": "doc_id::varchar", "P": "p_partkey::varchar"}

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_built: dict[tuple[str, str, str], SearchIndex] = {}
#: Bytes of files up to which an index is kept whole; texts and tokens in memory are several times that, and of larger tables would go to disk.
KEPT_BYTES = 64_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def index_of(spark: SparkSession, sf_dir: str, corpus: str) -> SearchIndex:
    """The index of a corpus, built and kept once a session as a search engine keeps its own; of a table of more than KEPT_BYTES the dictionary is kept."""
    key = (spark.sparkContext.applicationId, sf_dir, corpus)
    if key not in _built:
        name, config = CORPORA[corpus]
        df = table(spark, sf_dir, name)
        made = SearchIndex.build(df, config, unique_ids=True)
        small = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= KEPT_BYTES
        _built[key] = made.persist() if small else made.persist_dictionary()
    return _built[key]


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


# -- SQL of the index and of scores


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_tokens(expr: str, language: str = "en") -> str:
    parts = f"regexp_split_to_array(lower({expr}), '[^\\p{{L}}\\p{{N}}'']+')"
    if language == "none":
        return f"list_filter({parts}, lambda t: t <> '')"
    words = ", ".join(quote(w) for w in sorted(STOPWORDS))
    return f"list_filter({parts}, lambda t: len(t) >= 2 and t not in ({words}))"


def sql_index(corpus: str, source: str | None = None) -> str:
    """CTEs docs, ft, fl, stats, post, dict of a corpus."""
    name, config = CORPORA[corpus]
    fields = " union all ".join(f"select doc_id, '{f}' as field, {sql_tokens(f)} as toks from docs where coalesce({f}, '') <> ''" for f in config.fields)
    rest = "* exclude (doc_id)" if corpus == "D" else "*"
    return f"""docs as (select {IDS[corpus]} as doc_id, {rest} from {source or name}),
ft as ({fields}),
fl as (select doc_id, field, len(toks) as len from ft),
total as (select count(*) as n from docs),
stats as (select field, sum(len)::double / (select n from total) as a from fl group by field),
post as (select doc_id, field, term, count(*) as tf from (select doc_id, field, unnest(toks) as term from ft) group by all),
dict as (select field, term, count(*) as df from post group by all)"""


def sql_kind(term: str, token: str, distance: int = 2) -> str:
    d = fuzzy_distance(len(token), distance)
    out = f"when {term} = {quote(token)} then 0"
    out += f" when starts_with({term}, {quote(token)}) then 1" if len(token) >= 2 else ""
    out += f" when abs(len({term}) - {len(token)}) <= {d} and levenshtein({term}, {quote(token)}) <= {d} then 2" if d else ""
    return f"case {out} end"


def sql_raw(corpus: str, query: str, fields: Sequence[str] | None = None, boost: bool = True, where: str | None = None, source: str | None = None) -> str:
    """CTEs up to scored(doc_id, raw_score, kind, score)."""
    config = CORPORA[corpus][1]
    own = list(config.fields) if fields is None else list(fields)
    toks = query_tokens(None, query, config.tokenizer)
    matches = " union all ".join(f"select {i} as ord, field, term, df, {sql_kind('term', t)} as kind from dict" for i, t in enumerate(toks))
    weights = " union all ".join(f"select '{f}' as field, {float(config.fields[f].weight)}::double as w" for f in own)
    gate = f"where doc_id in (select doc_id from docs where {where})" if where else ""
    phrase = "select null::varchar as doc_id where false"
    if boost and len(toks) > 1:
        values = ", ".join(f"({i}, {quote(t)})" for i, t in enumerate(toks))
        phrase = f"""select distinct doc_id from (
    select p.doc_id, p.field, p.pos - q.i as start from (select doc_id, field, unnest(toks) as term, unnest(range(len(toks))) as pos from ft where field in ({', '.join(quote(f) for f in own)})) p
    join (values {values}) q(i, tok) on p.term = q.tok group by all having count(distinct q.i) = {len(toks)})"""
    return f"""with {sql_index(corpus, source)},
weights as ({weights}),
matched as (select * from ({matches}) where kind is not null),
parts as (
    select p.doc_id, m.kind, ln(((select n from total) - m.df + 0.5::double) / (m.df + 0.5::double) + 1) * p.tf * 2.2::double / (p.tf + 1.2::double * (0.25::double + 0.75::double * l.len / s.a)) * w.w as s
    from matched m join weights w using (field) join post p using (field, term) join fl l on l.doc_id = p.doc_id and l.field = m.field join stats s on s.field = m.field
),
phrases as ({phrase}),
raw as (select doc_id, sum(s) * max(case when doc_id in (select doc_id from phrases) then 1.5::double else 1.0::double end) as raw_score, min(kind) as kind from parts {gate} group by doc_id),
scored as (select *, case when max(raw_score) over () > 0 then raw_score / max(raw_score) over () else raw_score end as score from raw)
"""


SHOWN = "doc_id, round(score, 6) as score, round(raw_score, 6) as raw_score, ['exact', 'prefix', 'fuzzy'][kind + 1] as match_type"


def hits(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.round("score", 6).alias("score"), F.round("raw_score", 6).alias("raw_score"), "match_type")


def add_search(name: str, corpus: str, query: str, limit: int | None = 10, offset: int = 0, filter: Any = None, where: str | None = None, min_score: float = 0.0, sort: Mapping | None = None, order: str | None = None, **options: Any) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return hits(index_of(spark, sf_dir, corpus).search(query, limit=limit, offset=offset, filter=filter, min_score=min_score, sort=sort, highlight=False, **options).hits)

    by = order or "round(score, 12) desc, doc_id"
    page = f"order by {by} " + (f"limit {limit} " if limit is not None else "") + f"offset {offset}"
    sql = sql_raw(corpus, query, options.get("fields"), options.get("boost_exact", True), where)
    joined = "scored join docs using (doc_id)" if order else "scored"
    add(name, run, f"{sql} select {SHOWN} from (select * from {joined} where score >= {min_score} {page})")


add_search("search_exact_bm25", "D", "moron scum")
add_search("search_multi_field_weights", "P", "blue widget anvil")
add_search("search_duplicate_token", "P", "widget widget ring")
add_search("search_prefix", "D", "path")
add_search("search_fuzzy", "D", "worthles")
add_search("search_mixed_match_type", "D", "idiott clo trash", limit=50)
add_search("search_phrase_boost", "P", "blue bolt", limit=40)
add_search("search_no_boost", "P", "blue bolt", limit=40, boost_exact=False)
add_search("search_phrase_documents", "D", "ththin the then")
add_search("search_min_score", "P", "red ring", limit=None, min_score=0.6)
add_search("search_fields_subset", "P", "large ring", fields=["p_name"])
add_search("search_page2", "P", "hot rod", limit=7, offset=7)
add_search("search_unlimited", "D", "disgusting", limit=None)
add_search("search_filtered", "P", "gizmo plate", filter={"AND": [{"field": "p_size", "operator": "gte", "value": 10}, {"field": "p_retailprice", "operator": "lt", "value": 950}]}, where="p_size >= 10 and p_retailprice < 950")
add_search("search_filtered_lang", "D", "pathetic clown", filter={"field": "lang", "operator": "eq", "value": "en"}, where="lang = 'en'")
add_search("search_sort_number", "P", "small gear", sort={"field": "p_retailprice", "direction": "desc"}, order="p_retailprice desc, round(score, 12) desc, doc_id")
add_search("search_sort_string", "P", "small gear", sort={"field": "p_name", "direction": "asc", "type": "string"}, order="p_name, round(score, 12) desc, doc_id")
add("search_total", lambda s, d: index_of(s, d, "P").search("new old").candidates.agg(F.count("*").alias("total")), f"{sql_raw('P', 'new old')} select count(*) as total from scored where score >= 0")
add("search_blank", lambda s, d: hits(index_of(s, d, "P").search("  the ", facets={"p_size": {}}).hits), "select ''::varchar as doc_id, 0::double as score, 0::double as raw_score, '' as match_type where false")
add("search_matched_tokens", lambda s, d: index_of(s, d, "P").search("widget anvil", limit=25).hits.select("doc_id", F.array_join("matched_tokens", " ").alias("found")), f"""{sql_raw('P', 'widget anvil')},
found as (select p.doc_id, m.ord, min(['p_name', 'p_brand', 'p_type'].list_position(m.field) * 10 + m.ord) as place from matched m join post p using (field, term) group by all)
select doc_id, string_agg(['widget', 'anvil'][ord + 1], ' ' order by place) as found from (select doc_id from scored order by round(score, 12) desc, doc_id limit 25) join found using (doc_id) group by doc_id""")

# -- analysis and index tables

add(
    "tokenize_positions",
    lambda s, d: index_of(s, d, "D").tokens.filter("field = 'text'").select("doc_id", F.posexplode("tokens").alias("position", "term")).groupBy("term").agg(F.count("*").alias("n"), F.sum(F.col("position").cast("long")).alias("positions")),
    f"select term, count(*) as n, sum(pos)::bigint as positions from (select unnest(t) as term, unnest(range(len(t))) as pos from (select {sql_tokens('text')} as t from documents)) group by term",
)
add(
    "tokenize_none",
    lambda s, d: table(s, d, "documents").select(F.explode(tokens(F.col("text"), TokenizerConfig(language="none"))).alias("term")).groupBy("term").agg(F.count("*").alias("n")),
    f"select term, count(*) as n from (select unnest({sql_tokens('text', 'none')}) as term from documents) group by term",
)
add("field_lengths", lambda s, d: index_of(s, d, "D").field_len.select("doc_id", "field", F.col("len").cast("long").alias("n_tokens")), f"with {sql_index('D')} select doc_id, field, len as n_tokens from fl")
add("avg_field_length", lambda s, d: s.createDataFrame([(f, float(v)) for f, v in index_of(s, d, "D").statistics().items() if f], "field string, average double").withColumn("average", F.round("average", 6)), f"with {sql_index('D')} select field, round(a, 6) as average from stats")
add("dictionary_df", lambda s, d: index_of(s, d, "D").dictionary.select("field", "term", F.col("term_len").cast("long").alias("term_len"), "df"), f"with {sql_index('D')} select field, term, len(term) as term_len, df from dict")
add("postings_tf", lambda s, d: index_of(s, d, "P").postings.select("field", "term", "doc_id", F.col("tf").cast("long").alias("tf"), F.array_join(F.transform("positions", lambda x: x.cast("string")), " ").alias("positions")), f"""with {sql_index('P')}
select field, term, doc_id, count(*) as tf, string_agg(pos::varchar, ' ' order by pos) as positions from (select doc_id, field, unnest(toks) as term, unnest(range(len(toks))) as pos from ft) group by field, term, doc_id""")
add("term_count", lambda s, d: index_of(s, d, "D").dictionary.agg(F.count("*").alias("term_count")), f"with {sql_index('D')} select count(*) as term_count from dict")
add("trie_node_count", lambda s, d: index_of(s, d, "P").trie_nodes().agg(F.count("*").alias("trie_node_count")), f"with {sql_index('P')} select count(distinct word[:i]) as trie_node_count from (select term as word, unnest(range(1, len(term) + 1)) as i from dict where len(term) >= 2)")
add("document_count", lambda s, d: index_of(s, d, "D").docs.agg(F.count("*").alias("document_count")), "select count(*) as document_count from documents")
add("memory_estimate", lambda s, d: index_of(s, d, "P").docs.agg(F.sum(F.char_length(F.to_json("doc")) * 2 + 200).alias("memory_estimate_bytes")), "select sum(len(to_json(part)::varchar) * 2 + 200)::bigint as memory_estimate_bytes from part")

# -- expansion

add("expand_term", lambda s, d: scoring.expand(index_of(s, d, "D").dictionary, "text", "worthless"), f"with {sql_index('D')} select term, df, ['exact', 'prefix', 'fuzzy'][kind + 1] as match_type, levenshtein(term, 'worthless')::int as distance from (select *, {sql_kind('term', 'worthless')} as kind from dict where field = 'text') where kind is not null")
add("fuzzy_terms", lambda s, d: scoring.fuzzy_terms(index_of(s, d, "P").dictionary, "p_name", "widgot"), f"with {sql_index('P')} select term, levenshtein(term, 'widgot')::int as distance from dict where field = 'p_name' and levenshtein(term, 'widgot') <= 1")
add(
    "levenshtein_bounded",
    lambda s, d: _words(s, d).alias("a").crossJoin(_words(s, d).alias("b")).select(F.col("a.word").alias("a"), F.col("b.word").alias("b"), F.levenshtein(F.col("a.word"), F.col("b.word"), 2).cast("long").alias("distance")),
    "with w as (select distinct unnest(string_split(p_name, ' ')) as word from part) select a.word as a, b.word as b, case when levenshtein(a.word, b.word) <= 2 then levenshtein(a.word, b.word) else -1 end as distance from w a, w b",
)
add(
    "adaptive_distance",
    lambda s, d: _words(s, d).select("word", fuzzy_distance_column(F.char_length("word"), 2).alias("two"), fuzzy_distance_column(F.char_length("word"), 1).alias("one")),
    "with w as (select distinct unnest(string_split(p_name, ' ')) as word from part) select word, (case when len(word) < 4 then 0 when len(word) < 7 then 1 else 2 end)::int as two, (case when len(word) < 4 then 0 else 1 end)::int as one from w",
)


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()


# -- filters


def add_filter(name: str, source: str, key: str, f: Any, where: str) -> None:
    add(f"filter_{name}", lambda s, d: filter_documents(table(s, d, source), f).select(key), f"select {key} from {source} where {where}")


def _is(field: str, operator: str, value: Any = None) -> dict:
    return {"field": field, "operator": operator, "value": value}


add_filter("eq", "part", "p_partkey", _is("p_brand", "eq", "Brand#1"), "p_brand = 'Brand#1'")
add_filter("eq_type_mismatch", "part", "p_partkey", _is("p_size", "eq", "5"), "false")
add_filter("neq", "orders", "o_orderkey", _is("o_orderstatus", "neq", "F"), "o_orderstatus <> 'F'")
add_filter("gt", "orders", "o_orderkey", _is("o_totalprice", "gt", 100000), "o_totalprice > 100000")
add_filter("gte", "part", "p_partkey", _is("p_size", "gte", 25), "p_size >= 25")
add_filter("lt", "lineitem", "l_orderkey", _is("l_quantity", "lt", 3), "l_quantity < 3")
add_filter("lte", "part", "p_partkey", _is("p_retailprice", "lte", 920.5), "p_retailprice <= 920.5")
add_filter("gt_on_dates", "orders", "o_orderkey", _is("o_orderdate", "gt", "1996-01-01"), "false")
add_filter("range", "part", "p_partkey", _is("p_size", "range", [10, 20]), "p_size between 10 and 20")
add_filter("in", "events", "event_id", _is("event_type", "in", ["click", "view", "purchase"]), "event_type in ('click', 'view', 'purchase')")
add_filter("nin", "events", "event_id", _is("event_type", "nin", ["click", 7]), "event_type not in ('click')")
add_filter("contains", "part", "p_partkey", _is("p_name", "contains", "WID"), "contains(lower(p_name), 'wid')")
add_filter("starts_with", "customer", "c_custkey", _is("c_mktsegment", "startsWith", "bu"), "starts_with(lower(c_mktsegment), 'bu')")
add_filter("exists", "orders", "o_orderkey", _is("o_orderdate", "exists"), "o_orderdate is not null")
add_filter("exists_missing", "orders", "o_orderkey", _is("no.such.path", "exists", True), "false")
add_filter("unknown", "part", "p_partkey", _is("p_size", "near", 3), "false")
add_filter("and", "part", "p_partkey", {"AND": [_is("p_size", "gt", 5), _is("p_name", "contains", "ring")]}, "p_size > 5 and contains(p_name, 'ring')")
add_filter("or", "part", "p_partkey", {"OR": [_is("p_size", "eq", 5), _is("p_name", "startsWith", "red")]}, "p_size = 5 or starts_with(p_name, 'red')")
add_filter("not", "part", "p_partkey", {"NOT": _is("p_size", "range", [5, 45])}, "not (p_size between 5 and 45)")
add_filter("nested", "orders", "o_orderkey", {"AND": [{"OR": [_is("o_orderstatus", "eq", "O"), _is("o_totalprice", "lt", 5000)]}, {"NOT": {"OR": [_is("o_orderpriority", "in", ["1-URGENT"]), _is("o_custkey", "gte", 1000)]}}]}, "(o_orderstatus = 'O' or o_totalprice < 5000) and not (o_orderpriority in ('1-URGENT') or o_custkey >= 1000)")
add_filter("empty_and", "nation", "n_nationkey", {"AND": []}, "true")
add_filter("empty_or", "nation", "n_nationkey", {"OR": []}, "false")
add_filter("trivial", "nation", "n_nationkey", {}, "true")
add_filter("first_key_wins", "nation", "n_nationkey", {"AND": [_is("n_regionkey", "eq", 1)], "OR": [_is("n_regionkey", "eq", 2)]}, "n_regionkey = 1")


def _with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumns({"event_type": F.when(F.col("user_id") % 3 != 0, F.col("event_type")), "value": F.when(F.col("user_id") % 5 != 0, F.col("value"))})


_NULLS = "(select event_id, case when user_id % 3 <> 0 then event_type end as event_type, case when user_id % 5 <> 0 then value end as value from events)"
for _name, _f, _where in (
    ("neq", _is("event_type", "neq", "click"), "event_type is distinct from 'click'"),
    ("nin", _is("event_type", "nin", ["click", "view"]), "coalesce(event_type not in ('click', 'view'), true)"),
    ("not_gt", {"NOT": _is("value", "gt", 10)}, "not coalesce(value > 10, false)"),
    ("not_eq", {"NOT": _is("event_type", "eq", "click")}, "event_type is distinct from 'click'"),
    ("not_contains", {"NOT": _is("event_type", "contains", "c")}, "not coalesce(contains(event_type, 'c'), false)"),
    ("eq_null", _is("value", "eq", None), "value is null"),
    ("in_null", _is("event_type", "in", ["click", None]), "event_type = 'click' or event_type is null"),
    ("exists", {"NOT": _is("value", "exists")}, "value is null"),
):
    add(f"filter_nulls_{_name}", lambda s, d, f=_f: filter_documents(_with_nulls(s, d), f).select("event_id"), f"select event_id from {_NULLS} where {_where}")

# -- facets

ISO = "'%Y-%m-%dT%H:%M:%S.000Z'"
add("facet_terms", lambda s, d: terms_facet(table(s, d, "part"), "p_brand", 5), "select p_brand as key, count(*) as count from part group by 1 order by 2 desc, 1 limit 5")
add("facet_terms_number", lambda s, d: terms_facet(table(s, d, "part"), "p_size"), "select p_size::varchar as key, count(*) as count from part group by p_size order by 2 desc, 1 limit 10")
add("facet_terms_array", lambda s, d: terms_facet(table(s, d, "part").withColumn("words", F.split("p_name", " ")), "words", 12), "select key, count(*) as count from (select unnest(string_split(p_name, ' ')) as key from part) group by key order by 2 desc, 1 limit 12")
_RANGES = [{"label": "low", "to": 920}, {"label": "mid", "from": 910, "to": 960.5}, {"label": "high", "from": 960}, {"label": "all"}, {"label": "none", "from": 5000}]
_range_sql = " union all ".join(f"select {i}::int as ord, '{r['label']}' as key, count(*) as count from part where true" + (f" and p_retailprice >= {r['from']}" if "from" in r else "") + (f" and p_retailprice <= {r['to']}" if "to" in r else "") for i, r in enumerate(_RANGES))
add("facet_range", lambda s, d: range_facet(table(s, d, "part"), "p_retailprice", _RANGES), _range_sql)
add("facet_range_dates", lambda s, d: range_facet(table(s, d, "events"), "ts", [{"label": "first half", "to": 1705276800000}, {"label": "second half", "from": 1705276800000}]), "select 0::int as ord, 'first half' as key, count(*) as count from events where epoch_ms(ts) <= 1705276800000 union all select 1::int, 'second half', count(*) from events where epoch_ms(ts) >= 1705276800000")
for _unit, _source, _column, _cut in (("day", "events", "ts", "date_trunc('day', ts)"), ("week", "events", "ts", "(ts::date - dayofweek(ts)::int)"), ("month", "orders", "o_orderdate", "date_trunc('month', o_orderdate)"), ("year", "orders", "o_orderdate", "date_trunc('year', o_orderdate)")):
    add(f"facet_date_{_unit}", lambda s, d, t=_source, c=_column, u=_unit: date_facet(table(s, d, t), c, u), f"select strftime({_cut}::timestamp, {ISO}) as key, count(*) as count from {_source} group by 1")
add("facet_ignores_query", lambda s, d: index_of(s, d, "P").search("anvil", filter=_is("p_size", "lte", 20), facets={"p_brand": {"type": "terms", "size": 3}}).facets["p_brand"], "select p_brand as key, count(*) as count from part where p_size <= 20 group by 1 order by 2 desc, 1 limit 3")

# -- highlighting


def _highlighted(spark: SparkSession, sf_dir: str, corpus: str, query: str, field: str) -> DataFrame:
    h = index_of(spark, sf_dir, corpus).search(query, limit=10).hits.select("doc_id", F.explode("highlights").alias("h")).filter(F.col("h.field") == field)
    return h.select("doc_id", F.col("h.snippet").alias("snippet"), F.array_join("h.matched_tokens", " ").alias("found"))


add("highlight_basic", lambda s, d: _highlighted(s, d, "P", "widget", "p_name"), f"{sql_raw('P', 'widget')} select doc_id, regexp_replace(p_name, 'widget', '<mark>\\0</mark>', 'gi') as snippet, 'widget' as found from (select doc_id from scored order by round(score, 12) desc, doc_id limit 10) join docs using (doc_id) where contains(lower(p_name), 'widget')")
add("highlight_window", lambda s, d: _highlighted(s, d, "D", "loser", "text"), f"""{sql_raw('D', 'loser')},
page as (select doc_id, text, instr(lower(text), 'loser') - 1 as place, len(text) as n from (select doc_id from scored order by round(score, 12) desc, doc_id limit 10) join docs using (doc_id) where contains(lower(text), 'loser')),
cut as (select *, greatest(0, place - 30) as a, least(n, greatest(0, place - 30) + 160) as b from page)
select doc_id, regexp_replace(case when a > 0 then '…' else '' end || text[a + 1:b] || case when b < n then '…' else '' end, 'loser', '<mark>\\0</mark>', 'gi') as snippet, 'loser' as found from cut""")

# -- suggestions


def sql_suggest(q: str, most: int = 10, source: str | None = None) -> str:
    d = fuzzy_distance(len(q), 2)
    near = f" union all select word, frequency, 2 as kind, levenshtein(word, '{q}') as distance from words where not starts_with(word, '{q}') and abs(len(word) - {len(q)}) <= {d} and levenshtein(word, '{q}') <= {d} and (select count(*) from begins) < 3" if d else ""
    return f"""with {sql_index('P', source)},
words as (select term as word, count(*) as frequency from post where len(term) >= 2 group by term),
begins as (select word, frequency, case when word = '{q}' then 0 else 1 end as kind, 0 as distance from words where starts_with(word, '{q}') order by frequency desc, word limit {2 * most}),
best as (select * from (select * from begins{near}) order by kind, frequency desc, word limit {most})
select word as text, ['exact', 'prefix', 'fuzzy'][kind + 1] as match_type, frequency, distance::int as distance, (select string_agg(distinct doc_id, ' ' order by doc_id) from post p where starts_with(p.term, best.word) and len(p.term) >= 2) as document_ids from best"""


for _name, _q in (("prefix", "r"), ("exact_first", "red"), ("fuzzy_fallback", "widgot"), ("doc_ids", "brand"), ("nothing", "zzzzzz")):
    add(f"suggest_{_name}", lambda s, d, q=_q: index_of(s, d, "P").suggest(q).withColumn("document_ids", F.array_join("document_ids", " ")), sql_suggest(_q))

# -- browsing and documents

add("browse_filter_sort_page", lambda s, d: index_of(s, d, "P").browse(filter=_is("p_size", "gt", 40), sort={"field": "p_retailprice", "direction": "desc"}, limit=15, offset=5).documents.select("p_partkey", "p_name", "p_retailprice"), "select p_partkey, p_name, p_retailprice from part where p_size > 40 order by p_retailprice desc, p_partkey::varchar limit 15 offset 5")
add("browse_sort_date", lambda s, d: _order_index(s, d).browse(sort={"field": "o_orderdate", "direction": "asc", "type": "date"}, limit=20).documents.select("o_orderkey"), "select o_orderkey from orders order by o_orderdate, o_orderkey::varchar limit 20")
add("browse_total", lambda s, d: index_of(s, d, "P").browse(filter=_is("p_size", "lte", 7)).candidates.agg(F.count("*").alias("total")), "select count(*) as total from part where p_size <= 7")
add("get_by_id", lambda s, d: index_of(s, d, "P").get_by_id(17).select("p_partkey", "p_name"), "select p_partkey, p_name from part where p_partkey = 17")
add("has", lambda s, d: s.createDataFrame([(i, index_of(s, d, "P").has(i)) for i in (3, -3)], "id int, found boolean"), "select i::int as id, i in (select p_partkey from part) as found from (values (3), (-3)) t(i)")
add("all_documents", lambda s, d: index_of(s, d, "P").documents().select("p_partkey", "p_name"), "select p_partkey, p_name from part")


def _order_index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    return SearchIndex.build(table(spark, sf_dir, "orders"), IndexConfig.of(["o_orderpriority"], id_col="o_orderkey"), unique_ids=True)


# -- changes

_CHANGED = "(select p_partkey, case when p_partkey % 10 = 3 then 'renamed gizmo' else p_name end as p_name, p_brand, p_type, p_size, p_retailprice from part where p_partkey % 10 <> 4)"


def _changed(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The part index after an upsert of one part in ten and the removal of another one in ten."""
    part = table(spark, sf_dir, "part")
    gone = part.filter("p_partkey % 10 = 4").select(F.col("p_partkey").cast("string").alias("doc_id"))
    return index_of(spark, sf_dir, "P").add_many(part.filter("p_partkey % 10 = 3").withColumn("p_name", F.lit("renamed gizmo"))).remove_all(gone)


add("upsert_then_search", lambda s, d: hits(_changed(s, d).search("renamed widget", limit=30, highlight=False).hits), f"{sql_raw('P', 'renamed widget', source=_CHANGED)} select {SHOWN} from (select * from scored order by round(score, 12) desc, doc_id limit 30)")
add("remove_then_dictionary", lambda s, d: _changed(s, d).dictionary.select("field", "term", "df"), f"with {sql_index('P', _CHANGED)} select field, term, df from dict")
add("clear", lambda s, d: index_of(s, d, "P").clear().docs.agg(F.count("*").alias("n")), "select 0::bigint as n")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after the events' stream of changes: by user, the last event's type; refunds and such remove."""
    from lodestone.streaming.upserts import last_changes

    changes = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "click", "delete").otherwise("upsert").alias("op"), F.col("user_id").cast("string").alias("doc_id"), F.struct("ts", "event_id").alias("ts"), F.struct("event_type").alias("doc"))
    return last_changes(changes).filter("op = 'upsert'").select("doc_id", "doc.event_type")


add("stream_last_changes", _streamed, "select user_id::varchar as doc_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1 and event_type <> 'click'")

# -- several indexes, batches, hooks


def _searched_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = IndexManager()
    m.create_index("parts", index_of(spark, sf_dir, "P"))
    m.create_index("docs", index_of(spark, sf_dir, "D"))
    return hits(m.search_all("trash ring", {"parts": 0.5, "docs": 2.0}, limit=40, highlight=False).hits.withColumn("doc_id", F.concat_ws("/", "index", "doc_id")))


_one = lambda c, n, w: f"select '{n}/' || doc_id as doc_id, '{n}' as i, doc_id as id, score * {w}::double as score, raw_score, kind from ({sql_raw(c, 'trash ring')} select * from scored)"
add("search_all_weighted", _searched_all, f"with every as ({_one('P', 'parts', 0.5)} union all {_one('D', 'docs', 2.0)}), top as (select *, score / greatest(1, max(score) over ()) as s from every) select doc_id, round(s, 6) as score, round(raw_score, 6) as raw_score, ['exact', 'prefix', 'fuzzy'][kind + 1] as match_type from (select * from top order by round(s, 12) desc, i = 'docs', id limit 40)")

BATCH = ("blue widget", "ring", "widgot", "larg", "cold cold rod")
add(
    "search_batch",
    lambda s, d: index_of(s, d, "P").search_batch(s.createDataFrame(list(enumerate(BATCH)), "query_id int, query string"), limit=10).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.round("raw_score", 6).alias("raw_score"), "match_type", "rank"),
    " union all ".join(f"select {i}::int as query_id, {SHOWN}, rank from ({sql_raw('P', q, boost=False)} select *, row_number() over (order by round(score, 12) desc, doc_id)::int as rank from scored qualify rank <= 10)" for i, q in enumerate(BATCH)),
)


def _hooked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary with a stemmer that drops a final s, a normalizer that takes out digits, and an extracted field."""
    config = IndexConfig.of({"p_name": FieldConfig(), "both": FieldConfig(extract=F.concat_ws(" ", "p_name", "p_type"))}, id_col="p_partkey", tokenizer=TokenizerConfig(stemmer=lambda t: F.regexp_replace(t, "s$", ""), normalizer=lambda t: F.regexp_replace(t, "[0-9]", "")))
    return SearchIndex.build(table(spark, sf_dir, "part"), config, unique_ids=True).dictionary.select("field", "term", "df")


_stem = lambda e: "list_filter(list_transform(list_filter(regexp_split_to_array(lower(regexp_replace(" + e + ", '[0-9]', '', 'g')), '[^\\p{L}\\p{N}'']+'), lambda t: t <> ''), lambda t: regexp_replace(t, 's$', '')), lambda t: len(t) >= 2 and t not in (" + ", ".join(quote(w) for w in sorted(STOPWORDS)) + "))"
add("hooks_stemmer_normalizer_extract", _hooked, f"select field, term, count(*) as df from (select distinct p_partkey, field, unnest(toks) as term from (select p_partkey, 'p_name' as field, {_stem('p_name')} as toks from part union all select p_partkey, 'both', {_stem("p_name || ' ' || p_type")} from part)) group by all")

add("hook_id_expr", lambda s, d: _parts(s, d, {"p_name": {}}, id_expr=F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string"))).docs.select("doc_id"), "select p_brand || '-' || p_partkey::varchar as doc_id from part")
add("hook_tokenize", lambda s, d: _parts(s, d, {"p_name": {}, "p_type": {}}, id_col="p_partkey", tokenizer=TokenizerConfig(tokenize=lambda t: F.split(F.upper(t), "[ #]"))).dictionary.select("field", "term", "df"), "select field, term, count(*) as df from (select distinct p_partkey, field, unnest(string_split(upper(v), ' ')) as term from (select p_partkey, 'p_name' as field, p_name as v from part union all select p_partkey, 'p_type', p_type from part)) group by all")
add("hook_stopwords", lambda s, d: _parts(s, d, {"p_name": {}}, id_col="p_partkey", tokenizer=TokenizerConfig(stopwords=("red", "ring", "the"))).dictionary.select("term", "df"), "select term, count(distinct p_partkey) as df from (select p_partkey, unnest(string_split(p_name, ' ')) as term from part) where term not in ('red', 'ring', 'the') and len(term) >= 2 group by term")


def _parts(spark: SparkSession, sf_dir: str, fields: Any, **options: Any) -> SearchIndex:
    return SearchIndex.build(table(spark, sf_dir, "part"), IndexConfig.of(fields, **options), unique_ids=True)


# -- documents with structs, arrays and maps

_NESTED = """(select p_partkey, p_name, p_brand, p_type, p_size, string_split(p_name, ' ') as words from part)"""


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as (id, info<size, words, more<brand>>, labels: a map)."""
    info = F.struct(F.col("p_size").alias("size"), F.split("p_name", " ").alias("words"), F.struct(F.col("p_brand").alias("brand")).alias("more"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), info.alias("info"), F.create_map(F.lit("kind"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string")).alias("labels"))


def _add_path(name: str, f: Any, where: str) -> None:
    add(f"filter_path_{name}", lambda s, d: filter_documents(_nested(s, d), f).select("id"), f"select p_partkey as id from {_NESTED} where {where}")


_add_path("struct", _is("info.more.brand", "eq", "Brand#1"), "p_brand = 'Brand#1'")
_add_path("number", _is("info.size", "gte", 30), "p_size >= 30")
_add_path("array_item", _is("info.words.1", "eq", "ring"), "words[2] = 'ring'")
_add_path("map", _is("labels.kind", "startsWith", "eco"), "starts_with(lower(p_type), 'eco')")
_add_path("missing", {"NOT": _is("info.none.brand", "exists")}, "true")
NESTED_FIELDS = {"words": FieldConfig(path="info.words", weight=2.0), "brand": FieldConfig(path="info.more.brand"), "labels": FieldConfig(), "info": FieldConfig(suggest=False)}
_FLAT = {"words": "p_name", "brand": "p_brand", "labels": "p_type || ' ' || p_size::varchar", "info": "p_size::varchar || ' ' || p_name || ' ' || p_brand"}
_flat_terms = " union all ".join(f"select p_partkey::varchar as doc_id, '{f}' as field, unnest({sql_tokens(e)}) as term from part" for f, e in _FLAT.items())
add("nested_postings", lambda s, d: _nested_index(s, d).postings.select("field", "term", "doc_id", F.col("tf").cast("long").alias("tf")), f"select field, term, doc_id, count(*) as tf from ({_flat_terms}) group by all")
add("nested_search", lambda s, d: _nested_index(s, d).search("anvil", fields=["words"], limit=None, filter=_is("info.size", "lt", 25), highlight=False).hits.select("doc_id", "match_type"), "select p_partkey::varchar as doc_id, 'exact' as match_type from part where p_size < 25 and list_contains(string_split(p_name, ' '), 'anvil')")
add("nested_highlight", lambda s, d: _nested_index(s, d).search("anvil", fields=["words"], limit=None).hits.select("doc_id", F.explode("highlights").alias("h")).select("doc_id", "h.field", "h.snippet"), "select p_partkey::varchar as doc_id, 'words' as field, regexp_replace(p_name, 'anvil', '<mark>\\0</mark>', 'gi') as snippet from part where contains(p_name, 'anvil')")
add("field_values", lambda s, d: _nested(s, d).select("id", *(field_text(_nested(s, d), n, FieldConfig(path=path)).alias(n) for n, path in (("first", "info.words.0"), ("brand", "info.more.brand"), ("size", "info.size"), ("all_words", "info.words"), ("kind", "labels.kind"), ("none", "info.absent.x")))), f"select p_partkey as id, words[1] as first, p_brand as brand, p_size::varchar as size, p_name as all_words, p_type as kind, '' as none from {_NESTED}")


def _nested_index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    return SearchIndex.build(_nested(spark, sf_dir), IndexConfig.of(NESTED_FIELDS, id_col="id"), unique_ids=True)


# -- orders of texts, dates and terms of other kinds


def _sorted(name: str, column: Any, sort: Mapping, by: str) -> None:
    add(name, lambda s, d: _sort_rows(s, d, column(), sort), f"select p_partkey, (row_number() over (order by {by}, p_partkey))::int as place from part qualify place <= 40")


def _sort_rows(spark: SparkSession, sf_dir: str, column: Any, sort: Mapping) -> DataFrame:
    df = table(spark, sf_dir, "part").withColumn("v", column)
    rows = sort_documents(df, {"field": "v", **sort}, "p_partkey").select("p_partkey").limit(40).collect()  # the first page
    return spark.createDataFrame([(r[0], i + 1) for i, r in enumerate(rows)], "p_partkey long, place int")


_price = lambda: F.format_string("%.1f", "p_retailprice")
_sorted("sort_text_auto_numbers", lambda: F.col("p_size").cast("string"), {"direction": "asc"}, "p_size")
_sorted("sort_text_auto_mixed", lambda: F.when(F.col("p_size") < 40, F.col("p_size").cast("string")).otherwise(F.lit("many")), {"direction": "asc"}, "(case when p_size < 40 then p_size::varchar else 'many' end) collate \"C\"")
_sorted("sort_text_as_number", _price, {"direction": "desc", "type": "number"}, "p_retailprice desc")
_sorted("sort_text_as_date", lambda: F.date_format(F.make_date(F.lit(2000), F.col("p_size") % 12 + 1, F.lit(5)), "yyyy-MM-dd"), {"direction": "desc", "type": "date"}, "p_size % 12 desc")
add("parse_dates", lambda s, d: table(s, d, "orders").select("o_orderkey", *(F.date_format(date_of(c, k), "yyyy-MM-dd HH:mm:ss").alias(n) for n, c, k in (("text", F.date_format("o_orderdate", "yyyy-MM-dd"), T.StringType()), ("millis", F.unix_millis(F.col("o_orderdate").cast("timestamp")), T.LongType()), ("day", F.to_date("o_orderdate"), T.DateType()), ("wrong", F.col("o_orderpriority"), T.StringType())))), "select o_orderkey, strftime(o_orderdate::date, '%Y-%m-%d %H:%M:%S') as text, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as millis, strftime(o_orderdate::date, '%Y-%m-%d %H:%M:%S') as day, null::varchar as wrong from orders")
add("normalize_term", lambda s, d: table(s, d, "customer").select("c_custkey", normalize_term(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("term")), "select c_custkey, lower(c_mktsegment) as term from customer")
add("escape_regex", lambda s, d: table(s, d, "part").select("p_partkey", *(F.regexp_replace(F.concat(F.col("p_brand"), F.lit(f" {x}")), quoted(F.lit(x)), F.lit("!")).alias(n) for n, x in _SIGNS.items())), "select p_partkey, " + ", ".join(f"p_brand || ' !' as {n}" for n in ("dot", "stars", "group", "quote")) + " from part")
_SIGNS = {"dot": "a.b", "stars": "**+?", "group": "([x]|{1})^$", "quote": "\\E\\Q"}
add("is_fuzzy_match", lambda s, d: _words(s, d).select("word", *(within_distance(F.col("word"), F.lit(w), n).alias(f"{w}_{n}") for w, n in (("rang", 1), ("widgets", 1), ("bule", 2)))), "with w as (select distinct unnest(string_split(p_name, ' ')) as word from part) select word, levenshtein(word, 'rang') <= 1 as rang_1, levenshtein(word, 'widgets') <= 1 as widgets_1, levenshtein(word, 'bule') <= 2 as bule_2 from w")
add("postings_by_prefix", lambda s, d: scoring.by_prefix(index_of(s, d, "P").postings, "p_name", "r").select("doc_id", F.array_join(F.transform("terms", lambda t: F.concat_ws(":", t["term"], t["tf"])), " ").alias("terms")), f"with {sql_index('P')} select doc_id, string_agg(term || ':' || tf::varchar, ' ' order by term) as terms from post where field = 'p_name' and starts_with(term, 'r') group by doc_id")
_scored = lambda i, q: ranked(i, i.query_tokens(q), list(i.config.fields), None, False)
add("merge_scores", lambda s, d: scoring.merged(_scored(index_of(s, d, "P"), "ring"), _scored(index_of(s, d, "P"), "widget ring"), _scored(index_of(s, d, "P"), "anvil")).select("doc_id", F.round("raw_score", 6).alias("raw_score")), "select doc_id, round(sum(raw_score), 6) as raw_score from (" + " union all ".join(f"select doc_id, raw_score from ({sql_raw('P', q, boost=False)} select * from scored)" for q in ("ring", "widget ring", "anvil")) + ") group by doc_id")
_GONE = "(select * from part where p_partkey % 3 <> 0 and not contains(p_name, 'red'))"
add("suggest_after_removal", lambda s, d: index_of(s, d, "P").remove_all(table(s, d, "part").filter("p_partkey % 3 = 0 or contains(p_name, 'red')").select(F.col("p_partkey").cast("string").alias("doc_id"))).suggest("r").withColumn("document_ids", F.array_join("document_ids", " ")), sql_suggest("r", source=_GONE))
add("suggest_after_clear", lambda s, d: index_of(s, d, "P").clear().suggest("r").select("text", "frequency"), "select ''::varchar as text, 0::bigint as frequency where false")

# -- persistence, several indexes and streams


def _folder(spark: SparkSession) -> str:
    """A folder of its own in the one that the session names for such, or on one machine in a temporary one."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if there is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = tempfile.mkdtemp(prefix="lodestone-")
    return f"{there.rstrip('/')}/index-{uuid.uuid4().hex}"


def _saved(spark: SparkSession, sf_dir: str) -> SearchIndex:
    path = _folder(spark)
    index_of(spark, sf_dir, "P").save(path)
    return SearchIndex.load(spark, path)


def _from_file(spark: SparkSession, sf_dir: str) -> SearchIndex:
    path = f"{_folder(spark)}.json"
    storage.save_to_file(index_of(spark, sf_dir, "P"), path)
    return storage.load_from_file(spark, path, CORPORA["P"][1])


def _imported(spark: SparkSession, sf_dir: str) -> SearchIndex:
    out = index_of(spark, sf_dir, "P").export()
    return SearchIndex.import_(out["documents"], IndexConfig.from_dict(out["config"]))


def _deserialised(spark: SparkSession, sf_dir: str) -> SearchIndex:
    return storage.deserialized_lines(storage.serialized_lines(index_of(spark, sf_dir, "P")), CORPORA["P"][1])


for _name, _made in (("saved_and_loaded", _saved), ("file", _from_file), ("export_import", _imported), ("serialized", _deserialised)):
    add(f"{_name}_search", lambda s, d, f=_made: hits(f(s, d).search("blue widgat anv", limit=30, highlight=False).hits), f"{sql_raw('P', 'blue widgat anv')} select {SHOWN} from (select * from scored order by round(score, 12) desc, doc_id limit 30)")
    add(f"{_name}_documents", lambda s, d, f=_made: f(s, d).documents().select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", "p_retailprice"), "select p_partkey, p_name, p_retailprice from part")
add("saved_dictionary", lambda s, d: _saved(s, d).dictionary.select("field", "term", "df"), f"with {sql_index('P')} select field, term, df from dict")


def _managed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a manager passes through to an index: changes, search, suggestions, browsing and counts."""
    part, m = table(spark, sf_dir, "part"), IndexManager()
    m.create_index("parts", index_of(spark, sf_dir, "P"))
    m.create_index("other", index_of(spark, sf_dir, "P"))
    m.add_many("parts", part.filter("p_partkey = 5").withColumn("p_name", F.lit("renamed gizmo")))
    m.remove("parts", 7, 8)
    m.remove_index("other")
    there = [(n, str(m.get_index(n) is not None)) for n in ("parts", "other", "none")]
    rows = [spark.createDataFrame([("index " + n, v) for n, v in there], "what string, value string")]
    rows.append(m.search("parts", "renamed").hits.select(F.lit("search").alias("what"), F.col("doc_id").alias("value")))
    rows.append(m.suggest("parts", "renam").select(F.lit("suggest").alias("what"), F.concat_ws(" ", "text", F.col("frequency").cast("string"), F.array_join("document_ids", " ")).alias("value")))
    rows.append(m.browse("parts", filter=_is("p_partkey", "lt", 10), limit=None).documents.select(F.lit("browse").alias("what"), F.col("p_partkey").cast("string").alias("value")))
    stats = m.stats("parts")
    rows.append(spark.createDataFrame([("documents", str(stats["document_count"])), ("fields", " ".join(stats["fields"]))], "what string, value string"))
    return reduce(lambda a, b: a.unionByName(b), rows)


add("manager_pass_throughs", _managed, "select unnest(['index parts', 'index other', 'index none']) as what, unnest(['True', 'False', 'False']) as value union all values ('search', '5'), ('suggest', 'renamed 1 5'), ('fields', 'p_name p_brand p_type') union all select 'browse', p_partkey::varchar from part where p_partkey < 10 and p_partkey not in (7, 8) union all select 'documents', (count(*) - 2)::varchar from part")


def _live(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The part index after two batches of a stream: one part in ten renamed, then another one removed."""
    path, part = _folder(spark), table(spark, sf_dir, "part")
    index_of(spark, sf_dir, "P").save(f"{path}/index")
    change = lambda op, ts: [F.lit(op).alias("op"), F.col("p_partkey").cast("string").alias("doc_id"), F.lit(ts).alias("ts"), F.struct(*part.columns).alias("doc")]
    for batch in (part.filter("p_partkey % 10 in (3, 4)").withColumn("p_name", F.lit("renamed gizmo")).select(*change("update", 1)), part.filter("p_partkey % 10 = 4").select(*change("delete", 2))):
        batch.coalesce(1).write.mode("append").parquet(f"{path}/changes")
        stream = spark.readStream.schema(batch.schema).parquet(f"{path}/changes")
        start_upserts(stream, f"{path}/index", f"{path}/checkpoint").awaitTermination()
    return SearchIndex.load(spark, f"{path}/index")


add("stream_upserts_search", lambda s, d: hits(_live(s, d).search("renamed widget", limit=30, highlight=False).hits), f"{sql_raw('P', 'renamed widget', source=_CHANGED)} select {SHOWN} from (select * from scored order by round(score, 12) desc, doc_id limit 30)")
