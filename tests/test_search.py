import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone import FieldConfig, FuzzyConfig, IndexConfig, IndexManager, SearchIndex
from lodestone.functions.analysis import STOPWORDS, fuzzy_distance
from lodestone.operators import scoring
from lodestone.operators.highlight import highlight

PRODUCT = "id string, title string, description string, category string, price double"
PRODUCTS = [("1", "Running Shoes", "Comfortable running shoes for daily use", "Footwear", 7500.0), ("2", "Basketball Sneakers", "High-top basketball shoes", "Footwear", 12000.0), ("3", "Yoga Mat", "Non-slip yoga mat", "Fitness", 2500.0)]
FIELDS = {"title": {"weight": 3}, "description": {}, "category": {"weight": 2}}


@pytest.fixture(scope="module")
def index(spark):
    return SearchIndex.build(spark.createDataFrame(PRODUCTS, PRODUCT), FIELDS).persist()


def found(result):
    return [(r["doc_id"], round(r["raw_score"], 6), round(r["score"], 6), r["match_type"]) for r in result.hits.collect()]


GOLDEN = [
    ("shoes", {}, [("1", 3.384662, 1.0, "exact"), ("2", 0.485275, 0.143375, "exact")]),
    ("shoess", {}, [("1", 3.384662, 1.0, "fuzzy"), ("2", 0.485275, 0.143375, "fuzzy")]),
    ("run", {}, [("1", 3.865242, 1.0, "prefix")]),
    ("running shoes", {}, [("1", 10.874856, 1.0, "exact"), ("2", 0.485275, 0.044624, "exact")]),
    ("running shoes", {"boost_exact": False}, [("1", 7.249904, 1.0, "exact"), ("2", 0.485275, 0.066935, "exact")]),
    ("shoes shoes", {}, [("1", 6.769324, 1.0, "exact"), ("2", 0.970549, 0.143375, "exact")]),
    ("shoes", {"filter": {"field": "price", "operator": "gte", "value": 10000}}, [("2", 0.485275, 1.0, "exact")]),
    ("shoes", {"fields": ["title"]}, [("1", 2.942488, 1.0, "exact")]),
    ("foot", {}, [("1", 0.940007, 1.0, "prefix"), ("2", 0.940007, 1.0, "prefix")]),
    ("shoes", {"fields": ["title", "title", "unknown"]}, [("1", 5.884976, 1.0, "exact")]),
    ("shoes", {"min_score": 0.5}, [("1", 3.384662, 1.0, "exact")]),
    ("shoes", {"limit": 1, "offset": 1}, [("2", 0.485275, 0.143375, "exact")]),
    ("shoes", {"sort": {"field": "price", "direction": "desc"}}, [("2", 0.485275, 0.143375, "exact"), ("1", 3.384662, 1.0, "exact")]),
    ("the", {}, []),
    ("", {}, []),
    ("zzzz", {}, []),
    ("shoes", {"fields": []}, []),
]


@pytest.mark.parametrize("query,options,want", GOLDEN, ids=lambda x: str(x)[:40])
def test_goldens(index, query, options, want):
    assert found(index.search(query, **options)) == want


def test_envelope(index):
    r = index.search("shoes", limit=1, facets={"category": {}})
    assert r.total() == 2 and r.has_more() and [tuple(x) for x in r.facets["category"].collect()] == [("Footwear", 2), ("Fitness", 1)]
    d = index.search("shoes", limit=2).to_dict()
    assert d["pagination"] == {"limit": 2, "offset": 0, "has_more": False} and d["hits"][0]["document"]["title"] == "Running Shoes"
    assert index.search("  the ", facets={"category": {}}).facets is None and index.search("  the ").query == "the"
    assert index.search("shoes", fields=[], facets={"category": {}}).facets["category"].count() == 2
    filtered = index.search("yoga", filter={"field": "category", "operator": "eq", "value": "Footwear"}, facets={"category": {}})
    assert filtered.total() == 0 and [tuple(x) for x in filtered.facets["category"].collect()] == [("Footwear", 2)]
    for bad in ({"limit": -1}, {"offset": -1}):
        with pytest.raises(ValueError):
            index.search("shoes", **bad)


def test_weights_of_zero_and_below(spark):
    df = spark.createDataFrame([("1", "red"), ("2", "red blue")], "id string, t string")
    assert [h[1:3] for h in found(SearchIndex.build(df, {"t": {"weight": 0.0}}).search("red"))] == [(0.0, 0.0)] * 2
    assert found(SearchIndex.build(df, {"t": {"weight": -1.0}}).search("red")) == []


def test_bm25_worked_example(spark):
    row = spark.sql("select 3 tf, 2L df, 50 len, 1 tf2, 30 len2").select(scoring.bm25(F.col("tf"), F.col("df"), F.col("len"), 10, F.lit(40.0), 1.2, 0.75), scoring.bm25(F.col("tf2"), F.col("df"), F.col("len2"), 10, F.lit(40.0), 1.2, 0.75)).first()
    assert [round(x, 6) for x in row] == [2.209851, 1.650395]


def test_normalised_and_boosted(spark):
    raw = spark.createDataFrame([("a", 10.0), ("b", 5.0), ("c", 2.5)], "doc_id string, raw_score double")
    assert [r["score"] for r in scoring.normalised(raw).orderBy("doc_id").collect()] == [1.0, 0.5, 0.25]
    assert [r["raw_score"] for r in scoring.boosted(raw, spark.createDataFrame([("a",)], "doc_id string")).orderBy("doc_id").collect()] == [15.0, 5.0, 2.5]
    assert [r["raw_score"] for r in scoring.merged(raw, raw).orderBy("doc_id").collect()] == [20.0, 10.0, 5.0]


def test_postings_and_expansion(spark):
    df = spark.createDataFrame([("1", "hello world"), ("2", "hello there none hello"), ("3", "testing tested")], "id string, title string")
    index = SearchIndex.build(df, ["title"])
    p = {(r["term"], r["doc_id"]): (r["positions"], r["tf"], r["len"]) for r in index.postings.collect()}
    assert p["hello", "2"] == ([0, 3], 2, 4) and p["tested", "3"] == ([1], 1, 2)
    assert {r["term"]: r["df"] for r in index.dictionary.filter("term in ('hello', 'tested')").collect()} == {"hello": 2, "tested": 1}
    kinds = lambda t: {(r["term"], r["match_type"]) for r in scoring.expand(index.dictionary, "title", t).collect()}
    assert kinds("test") == {("testing", "prefix"), ("tested", "prefix")} and kinds("hallo") == {("hello", "fuzzy")} and kinds("hello") == {("hello", "exact")} and kinds("h") == set()
    assert [tuple(r) for r in scoring.fuzzy_terms(index.dictionary, "title", "testin").collect()] == [("testing", 1)]
    assert [tuple(r) for r in scoring.fuzzy_terms(index.dictionary, "title", "the").collect()] == []
    phrases = lambda *t: {r[0] for r in scoring.phrase_docs(index.postings, t, ["title"]).collect()}
    assert phrases("hello", "world") == {"1"} and phrases("world", "hello") == set() and phrases("none", "hello") == {"2"}


def test_phrase_with_repeated_token(spark):
    df = spark.createDataFrame([("1", "xx xx yy"), ("2", "xx yy xx")], "id string, t string")
    p = SearchIndex.build(df, ["t"]).postings
    assert {r[0] for r in scoring.phrase_docs(p, ["xx", "xx"], ["t"]).collect()} == {"1"}


# -- an independent model


class Model:
    def __init__(self, docs, fields):
        tok = lambda t: [x for x in re.split(r"[^a-z0-9']+", t.lower()) if len(x) >= 2 and x not in STOPWORDS]
        self.docs, self.fields, self.tok = docs, fields, tok
        self.toks = {f: {d: tok(v[f]) for d, v in docs.items() if v[f]} for f in fields}

    def lev(self, a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def kind(self, term, t):
        if term == t:
            return 0
        if len(t) >= 2 and term.startswith(t):
            return 1
        d = fuzzy_distance(len(t), 2)
        return 2 if d and self.lev(term, t) <= d else None

    def search(self, query):
        q, raw, kinds, n = self.tok(query), Counter(), {}, len(self.docs)
        for f, w in self.fields.items():
            own = self.toks[f]
            average = sum(map(len, own.values())) / n
            df = Counter(t for x in own.values() for t in set(x))
            for t in q:
                for term, k in ((term, self.kind(term, t)) for term in df):
                    if k is None:
                        continue
                    idf = math.log((n - df[term] + 0.5) / (df[term] + 0.5) + 1)
                    for d, x in own.items():
                        if tf := x.count(term):
                            raw[d] += w * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / average))
                            kinds[d] = min(kinds.get(d, 9), k)
        if len(q) > 1:
            for d in raw:
                if any(q == x[i : i + len(q)] for f in self.fields for x in [self.toks[f].get(d, [])] for i in range(len(x))):
                    raw[d] *= 1.5
        top = max(raw.values(), default=0)
        return sorted((d, round(s, 6), round(s / top, 6), ("exact", "prefix", "fuzzy")[kinds[d]]) for d, s in raw.items())


def test_random_corpus_matches_model(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcde") for _ in range(r.randrange(1, 9))) for _ in range(60)] + ["the", "of"]
    docs = {str(i): {"a": " ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 12))), "b": r.choice((None, " ".join(r.choice(vocabulary) for _ in range(4))))} for i in range(50)}
    model = Model(docs, {"a": 1.0, "b": 2.5})
    df = spark.createDataFrame([(d, v["a"], v["b"]) for d, v in docs.items()], "id string, a string, b string")
    index = SearchIndex.build(df, {"a": {}, "b": {"weight": 2.5}}).persist()
    queries = [" ".join(r.choice(vocabulary) for _ in range(n)) for n in (1, 1, 2, 3)] + [docs["3"]["a"]]
    for q in queries:
        assert sorted(found(index.search(q, limit=None, highlight=False))) == model.search(q), q
    batch = index.search_batch(spark.createDataFrame(list(enumerate(queries)), "query_id int, query string"), limit=1000).collect()
    for i, q in enumerate(queries):
        single = {h[0]: h[1:] for h in found(index.search(q, limit=None, boost_exact=False, highlight=False))}
        assert {x["doc_id"]: (round(x["raw_score"], 6), round(x["score"], 6), x["match_type"]) for x in batch if x["query_id"] == i} == single, q
    q = queries[2]
    whole = [h[0] for h in found(index.search(q, limit=None))]
    assert [h[0] for k in range(0, len(whole), 4) for h in found(index.search(q, limit=4, offset=k))] == whole


# -- highlighting


def snippet(spark, value, tokens):
    h = spark.range(1).select(highlight(F.lit(value), F.lit(tokens)).alias("h")).first()["h"]
    return h["snippet"], h["matched_tokens"]


def test_highlights(spark):
    assert snippet(spark, "Red shoes and RED hats", ["red"]) == ("<mark>Red</mark> shoes and <mark>RED</mark> hats", ["red"])
    s, _ = snippet(spark, "A" * 50 + "target" + "B" * 200, ["target"])
    assert s == "…" + "A" * 30 + "<mark>target</mark>" + "B" * 124 + "…"
    assert snippet(spark, "price: $10.99", ["$10.99"]) == ("price: <mark>$10.99</mark>", ["$10.99"])
    assert snippet(spark, "nothing here", ["zz"]) == ("nothing here", [])
    assert snippet(spark, "x" * 300, ["zz"]) == ("x" * 160, [])
    assert snippet(spark, "marker mark", ["mark", "marker"])[0] == "<<mark>mark</mark>><mark>mark</mark>er</<mark>mark</mark>> <mark>mark</mark>"
    assert snippet(spark, r"a\Eb c", [r"a\eb"])[1] == [r"a\eb"] and "<mark>" in snippet(spark, r"a\Eb c", [r"a\eb"])[0]


def test_highlights_of_hits(index):
    own = {r["doc_id"]: [(h["field"], h["snippet"]) for h in r["highlights"]] for r in index.search("running", limit=5).hits.collect()}
    assert own == {"1": [("title", "<mark>Running</mark> Shoes"), ("description", "Comfortable <mark>running</mark> shoes for daily use")]}
    assert "highlights" not in index.search("running", highlight=False).hits.columns


# -- suggestions


def test_suggestions(spark):
    df = spark.createDataFrame([("doc1", "hello help helpful"), ("doc2", "hello helicopter"), ("doc3", "world hallo")], "id string, t string")
    index = SearchIndex.build(df, ["t"])
    got = [(r["text"], r["match_type"], r["frequency"]) for r in index.suggest("hel").collect()]
    assert got == [("hello", "prefix", 2), ("helicopter", "prefix", 1), ("help", "prefix", 1), ("helpful", "prefix", 1)]
    assert [(r["text"], r["match_type"], r["document_ids"]) for r in index.suggest(" HELP ").collect()][:2] == [("help", "exact", ["doc1"]), ("helpful", "prefix", ["doc1"])]
    assert [(r["text"], r["match_type"], r["distance"]) for r in index.suggest("halo").collect()] == [("hallo", "fuzzy", 1)]
    assert index.suggest("  ").count() == index.suggest("hello world").count() == index.suggest("zzzz").count() == 0
    off = SearchIndex.build(df, IndexConfig.of({"t": {"suggest": False}}))
    assert off.suggest("hel").count() == 0
    strict = SearchIndex.build(df, IndexConfig.of(["t"], fuzzy=FuzzyConfig(enabled=False)))
    assert strict.suggest("halo").count() == 0 and strict.search("halo").total() == 0


# -- documents, changes, statistics


def test_documents_and_changes(spark, index):
    assert index.get_by_id(2).first()["title"] == "Basketball Sneakers" and index.get_by_id("9").isEmpty() and index.has("1") and not index.has("x")
    new = spark.createDataFrame([("1", "Trail Boots", "for hills", "Footwear", 1.0), ("4", "Shoes Rack", "", "Home", 5.0)], PRODUCT)
    changed = index.add_many(new)
    assert [r["id"] for r in changed.documents().collect()] == ["2", "3", "1", "4"]
    assert {h[0] for h in found(changed.search("shoes"))} == {"2", "4"} and found(changed.search("running")) == []
    assert found(index.add_many(new).remove("4", "unknown").update(spark.createDataFrame(PRODUCTS[:1], PRODUCT)).search("shoes")) == found(index.search("shoes"))
    assert index.remove("1").stats()["document_count"] == 2 and index.clear().search("shoes").total() == 0 and index.clear().last_updated is None
    twice = SearchIndex.build(spark.createDataFrame([*PRODUCTS, ("1", "Hat", None, None, None)], PRODUCT).coalesce(1), FIELDS)
    assert twice.get_by_id("1").first()["title"] == "Hat" and twice.stats()["document_count"] == 3


def test_statistics(index):
    s = index.stats()
    assert s["document_count"] == 3 and s["term_count"] == 20 and s["fields"] == ["title", "description", "category"] and s["last_updated"] is not None
    words = {r["word"] for r in index.suggest_terms.collect()}
    assert s["trie_node_count"] == len({w[: i + 1] for w in words for i in range(len(w))})
    assert index.statistics()["title"] == 2.0


def test_ids_and_fields(spark):
    df = spark.createDataFrame([(1, ("Ann", ["x y", "z"]), 5.0), (2, ("Bob", []), 6.5)], "n int, p struct<name: string, tags: array<string>>, v double")
    index = SearchIndex.build(df, {"who": {"path": "p.name"}, "p.tags": {}, "both": FieldConfig(extract=F.concat_ws(" ", "p.name", "v")), "v": {}}, id_expr=F.concat(F.lit("k"), "n"))
    assert [h[0] for h in found(index.search("bob"))] == ["k2"] and found(index.search("z")) == [] and [h[0] for h in found(index.search("xx"))] == []
    assert {(r["field"], r["term"]) for r in index.postings.filter("term = 'ann'").collect()} == {("who", "ann"), ("both", "ann")}
    none = SearchIndex.build(df, ["p.name"], id_col="n")
    assert [h[0] for h in found(none.search("ann"))] == ["1"]
    with pytest.raises(ValueError):
        SearchIndex.build(df, ["v"])
    with pytest.raises(Exception, match="blank id"):
        SearchIndex.build(spark.createDataFrame([(" ", "a")], "id string, t string"), ["t"]).docs.collect()
    with pytest.warns(UserWarning, match="empty"):
        SearchIndex.build(df, {"gone": {}, "v": {}}, id_col="n", warn_empty=True)


def test_browse(index):
    ids = lambda **o: [r["id"] for r in index.browse(**o).documents.collect()]
    assert ids() == ["1", "2", "3"] and ids(sort={"field": "price"}) == ["3", "1", "2"] and ids(limit=1, offset=1) == ["2"]
    r = index.browse(filter={"field": "category", "operator": "eq", "value": "Footwear"}, limit=1)
    assert r.total() == 2 and r.has_more()


# -- several indexes


def test_manager(spark, index):
    m = IndexManager()
    m.create_index("a", index)
    m.create_index("b", SearchIndex.build(spark.createDataFrame([("9", "shoes here")], "key string, body string"), ["body"], id_col="key"))
    for bad in ("", "a"):
        with pytest.raises(ValueError):
            m.create_index(bad, index)
    with pytest.raises(KeyError):
        m.search("none", "x")
    with pytest.raises(KeyError):
        m.search_all("shoes", ["a", "none"])
    rows = lambda **o: [(r["index"], r["doc_id"], round(r["score"], 6)) for r in m.search_all("shoes", **o).hits.collect()]
    assert rows() == [("a", "1", 1.0), ("b", "9", 1.0), ("a", "2", 0.143375)]
    assert rows(indexes={"a": 0.5, "b": 0.25}) == [("a", "1", 0.5), ("b", "9", 0.25), ("a", "2", 0.071687)]
    assert rows(indexes={"a": 0.5, "b": 2.0}) == [("b", "9", 1.0), ("a", "1", 0.25), ("a", "2", 0.035844)]
    assert rows(indexes=["b", "b"]) == [("b", "9", 1.0)] * 2 and rows(indexes=[]) == [] and rows(limit=1, offset=1) == [("b", "9", 1.0)]
    r = m.search_all("shoes")
    assert r.total() == 3 and r.per_index() == {"a": 2, "b": 1}
    m.remove("b", "9")
    assert m.search("b", "shoes").total() == 0 and m.stats("b")["document_count"] == 0 and m.browse("a").total() == 3 and m.suggest("a", "yog").count() == 1
    m.add("b", spark.createDataFrame([("7", "shoes")], "key string, body string"))
    assert m.search("b", "shoes").total() == 1 and m.get_index("zz") is None and m.names() == ["a", "b"]
    m.remove_index("b")
    m.remove_index("b")
    assert m.get_index("b") is None


def test_plan_prunes_and_takes_the_top(spark, tmp_path, index):
    index.save(str(tmp_path / "i"))
    plan = SearchIndex.load(spark, str(tmp_path / "i")).search("shoes", fields=["title"], highlight=False).hits._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and re.search(r"PartitionFilters: \[[^]]*field#", plan) and re.search(r"PushedFilters: \[[^]]*(In|EqualTo)\(term", plan)
