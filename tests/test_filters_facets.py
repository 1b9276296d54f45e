import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators.facets import date_facet, facet, range_facet, terms_facet
from lodestone.operators.filters import compile_filter, filter_documents
from lodestone.operators.sorting import order, page, sort_documents

SCHEMA = "id int, title string, price double, size int, tags array<string>, active boolean, meta struct<level: string, n: array<int>>, at timestamp"
ROWS = [
    (1, "Red Shoes", 10.0, 1, ["a", "b", "a"], True, ("high", [1, 2]), "2024-01-06 23:00:00"),
    (2, "blue hat", 25.5, 2, ["b"], False, ("low", []), "2024-01-07 01:00:00"),
    (3, None, None, None, None, None, None, None),
    (4, "", float("nan"), 4, [], True, (None, [5]), "2024-02-01 00:00:00"),
    (5, "12", -3.0, 5, ["c", None], False, ("high", None), "2023-12-31 12:00:00"),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([r[:7] for r in ROWS], SCHEMA.rsplit(", at", 1)[0]).join(spark.createDataFrame([(r[0], r[7]) for r in ROWS], "id int, t string"), "id").withColumn("at", F.col("t").cast("timestamp")).drop("t").cache()


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def c(field, operator, value=None):
    return {"field": field, "operator": operator, "value": value}


NAN = float("nan")
CASES = [
    (c("title", "eq", "Red Shoes"), [1]), (c("title", "eq", "red shoes"), []), (c("size", "eq", "1"), []), (c("price", "eq", 10), [1]), (c("price", "eq", NAN), []), (c("active", "eq", True), [1, 4]), (c("active", "eq", 1), []),
    (c("tags", "eq", "b"), []), (c("title", "eq", None), [3]), (c("title", "neq", "blue hat"), [1, 3, 4, 5]), (c("price", "neq", NAN), [1, 2, 3, 4, 5]), (c("no", "neq", 1), [1, 2, 3, 4, 5]), (c("no", "eq", 1), []),
    (c("price", "gt", 10), [2]), (c("price", "gte", 10), [1, 2]), (c("price", "lt", 10), [5]), (c("price", "lte", 10), [1, 5]), (c("price", "gt", "10"), []), (c("title", "gt", 3), []), (c("at", "gt", 0), []), (c("price", "lt", NAN), []),
    (c("price", "range", [0, 25.5]), [1, 2]), (c("price", "range", ["-5", "10"]), [1, 5]), (c("price", "range", [1]), []), (c("price", "range", 3), []),
    (c("size", "in", [1, 5, "2"]), [1, 5]), (c("size", "in", 1), []), (c("size", "in", [1, None]), [1, 3]), (c("price", "in", [NAN]), [4]), (c("size", "in", []), []),
    (c("size", "nin", [1, 5]), [2, 3, 4]), (c("size", "nin", 1), []), (c("size", "nin", [None]), [1, 2, 4, 5]), (c("no", "nin", [1]), [1, 2, 3, 4, 5]), (c("price", "nin", [NAN]), [1, 2, 3, 5]),
    (c("title", "contains", "SHOE"), [1]), (c("title", "contains", ""), [1, 2, 4, 5]), (c("tags", "contains", "a"), []), (c("title", "startsWith", "BLUE"), [2]), (c("size", "startsWith", "1"), []),
    (c("title", "exists"), [1, 2, 4, 5]), (c("title", "exists", False), [1, 2, 4, 5]), (c("meta.level", "exists"), [1, 2, 5]), (c("no.where", "exists"), []), (c("meta.level", "eq", "high"), [1, 5]), (c("meta.n.0", "eq", 5), [4]), (c("meta.n.1", "exists"), [1]),
    ({"AND": [c("size", "gt", 1), c("active", "eq", False)]}, [2, 5]), ({"OR": [c("size", "eq", 1), c("title", "startsWith", "b")]}, [1, 2]), ({"NOT": c("price", "gt", 10)}, [1, 3, 4, 5]), ({"NOT": c("title", "eq", "12")}, [1, 2, 3, 4]), ({"NOT": c("title", "contains", "h")}, [3, 4, 5]),
    ({"NOT": {"OR": [c("size", "lt", 3), c("title", "exists")]}}, [3]), ({"AND": []}, [1, 2, 3, 4, 5]), ({"OR": []}, []), ({}, [1, 2, 3, 4, 5]), (None, [1, 2, 3, 4, 5]), ("text", [1, 2, 3, 4, 5]),
    ({"AND": [{"OR": [c("size", "eq", 1), {"AND": [c("size", "gte", 4), {"NOT": c("active", "eq", True)}]}]}, c("id", "lt", 9)]}, [1, 5]),
]


@pytest.mark.parametrize("f,want", CASES, ids=lambda x: str(x)[:60])
def test_filters(df, f, want):
    assert ids(filter_documents(df, f)) == want
    assert ids(df.filter(~compile_filter(df.schema, f, exact=False))) == sorted(set(range(1, 6)) - set(want))


def test_unknown_operator_and_mixed_groups_warn(df):
    with pytest.warns(UserWarning):
        assert ids(filter_documents(df, c("size", "near", 1))) == []
    with pytest.warns(UserWarning):
        assert ids(filter_documents(df, {"AND": [c("id", "eq", 1)], "OR": [c("id", "eq", 2)]})) == [1]


def model(row, f):
    if "operator" in f:
        v, w, op = row.get(f["field"]), f["value"], f["operator"]
        number = lambda x: isinstance(x, (int, float))
        if op == "eq":
            return v is not None and v == w and isinstance(v, str) == isinstance(w, str)
        if op == "neq":
            return not (v is not None and v == w)
        if op in ("gt", "lte"):
            return number(v) and number(w) and (v > w if op == "gt" else v <= w)
        if op in ("in", "nin"):
            return (v in w) == (op == "in")
        return isinstance(v, str) and w.lower() in v.lower()
    k = next(iter(f))
    if k == "NOT":
        return not model(row, f[k])
    return (all if k == "AND" else any)(model(row, x) for x in f[k])


def test_random_filters_match_model(spark):
    r = random.Random(1)
    rows = [(i, r.choice([None, 0, 1, 2, 3]), r.choice([None, "ab", "b", "ABC"])) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, n int, s string").cache()

    def made(depth):
        if depth and r.random() < 0.6:
            k = r.choice(("AND", "OR", "NOT"))
            return {k: made(depth - 1)} if k == "NOT" else {k: [made(depth - 1) for _ in range(r.randrange(1, 4))]}
        return r.choice((c("n", r.choice(("eq", "neq", "gt", "lte")), r.randrange(4)), c("n", r.choice(("in", "nin")), [1, 3]), c("s", r.choice(("eq", "neq")), r.choice(("ab", "b"))), c("s", "contains", "B")))

    made_ = [made(3) for _ in range(40)]
    got = df.select("id", *(compile_filter(df.schema, f, exact=False).alias(f"f{i}") for i, f in enumerate(made_))).collect()
    for row in got:
        own = dict(zip(("id", "n", "s"), rows[row["id"]]))
        for i, f in enumerate(made_):
            assert row[f"f{i}"] == model(own, f), (own, f)


def test_equality_reaches_the_scan(spark, tmp_path, df):
    df.select("id", "title").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    plan = filter_documents(t, {"AND": [c("title", "eq", "12"), c("id", "gt", 2)]})._jdf.queryExecution().toString()
    assert "EqualTo(title,12)" in plan and "GreaterThan(id,2)" in plan


def test_terms(df):
    assert [tuple(r) for r in terms_facet(df, "tags").collect()] == [("a", 2), ("b", 2), ("c", 1)]
    assert [tuple(r) for r in terms_facet(df, "tags", 1).collect()] == [("a", 2)]
    assert terms_facet(df, "active").count() == terms_facet(df, "at").count() == terms_facet(df, "no").count() == 0
    assert ("10", 1) in [tuple(r) for r in terms_facet(df, "price").collect()]
    assert [tuple(r) for r in terms_facet(df, "meta.level").collect()] == [("high", 2), ("low", 1)]


def test_ranges(df):
    got = range_facet(df, "price", [{"label": "low", "to": 10}, {"label": "both", "from": 10, "to": 25.5}, {"label": "all"}, {"label": "none", "from": 99}]).collect()
    assert [(r["key"], r["count"]) for r in got] == [("low", 2), ("both", 2), ("all", 3), ("none", 0)]
    assert [(r["key"], r["count"]) for r in range_facet(df, "title", [{"label": "zero", "from": 0, "to": 0}, {"label": "all"}]).collect()] == [("zero", 1), ("all", 2)]
    assert range_facet(df, "price", []).count() == 0
    assert range_facet(df, "active", [{"label": "x"}]).first()["count"] == 0


def test_dates(df):
    keys = lambda unit: [(r["key"][:10], r["count"]) for r in date_facet(df, "at", unit).collect()]
    assert keys("day") == [("2023-12-31", 1), ("2024-01-06", 1), ("2024-01-07", 1), ("2024-02-01", 1)]
    assert keys("week") == [("2023-12-31", 2), ("2024-01-07", 1), ("2024-01-28", 1)]
    assert keys("month") == [("2023-12-01", 1), ("2024-01-01", 2), ("2024-02-01", 1)]
    assert keys("year") == [("2023-01-01", 1), ("2024-01-01", 3)]
    assert date_facet(df, "title").count() == 0
    with pytest.raises(ValueError):
        date_facet(df, "at", "hour")
    with pytest.raises(ValueError):
        facet(df, "at", {"type": "odd"})


def test_sorting(spark, df):
    by = lambda **s: [r["id"] for r in sort_documents(df, s, "id").collect()]
    assert by(field="price") == [5, 1, 2, 3, 4] and by(field="price", direction="desc") == [2, 1, 5, 3, 4]
    assert by(field="at", type="date", direction="desc") == [4, 2, 1, 5, 3]
    assert by(field="title", type="number") == [4, 5, 1, 2, 3] and by(field="active") == [2, 5, 1, 4, 3] and by(field="no") == [1, 2, 3, 4, 5]
    words = spark.createDataFrame([(w,) for w in "b A é a B f".split()], "w string")
    assert [r["w"] for r in sort_documents(words, {"field": "w"}).collect()] == "a A b B é f".split()
    assert page(df.orderBy("id"), 2, 1).count() == 2 and page(df, None, 4).count() == 1
    for bad in ((-1, 0), (1, -1)):
        with pytest.raises(ValueError):
            page(df, *bad)
    with pytest.raises(ValueError):
        order(df.schema, {"field": "id", "direction": "up"})
    with pytest.raises(ValueError):
        order(df.schema, {"field": "id", "type": "odd"})


