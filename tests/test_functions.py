import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.config import IndexConfig, TokenizerConfig
from lodestone.functions.analysis import STOPWORDS, date_of, flatten, fuzzy_distance, fuzzy_distance_column, number_of, query_tokens, tokens, within_distance


def spark_tokens(spark, text, **config):
    return spark.range(1).select(tokens(F.lit(text), TokenizerConfig(**config)).alias("t")).first()["t"]


CASES = [
    ("The quick brown fox jumps over the lazy dog", "en", "quick brown fox jumps over lazy dog"),
    ("a apple is on the table", "en", "apple table"),
    ("the a an is are it", "en", ""),
    ("hello, world! how's it going?", "en", "hello world how's going"),
    ("the cat is here", "none", "the cat is here"),
    ("a b c hello", "en", "hello"),
    ("a b c hello", "none", "a b c hello"),
    ("", "en", ""),
    ("   ", "none", ""),
    ("Ünïcode Straße 42 x9", "en", "ünïcode straße 42 x9"),
    ("'quoted' it's", "en", "'quoted' it's"),
]


@pytest.mark.parametrize("text,language,want", CASES)
def test_tokenizer_and_its_twin(spark, text, language, want):
    assert spark_tokens(spark, text, language=language) == want.split()
    assert query_tokens(spark, text, TokenizerConfig(language=language)) == want.split()


def test_null_text_has_no_tokens(spark):
    assert spark_tokens(spark, None) == []


def test_combining_marks_split_words(spark):
    text = "नमस्ते"
    assert spark_tokens(spark, text, language="none") == query_tokens(spark, text, TokenizerConfig(language="none"))


def test_hooks(spark):
    config = TokenizerConfig(stemmer=lambda t: F.regexp_replace(t, "ing$", ""), normalizer=lambda t: F.replace(t, F.lit("é"), F.lit("e")))
    assert query_tokens(spark, "Café running thing", config) == ["cafe", "runn", "th"]
    own = TokenizerConfig(tokenize=lambda t: F.split(t, "-"))
    assert query_tokens(spark, "A-b-the", own) == ["A", "b", "the"]
    assert spark_tokens(spark, "red the", stopwords={"red"}) == ["the"]
    with pytest.raises(ValueError):
        TokenizerConfig(language="fr")


def test_stopwords():
    assert len(STOPWORDS) == 74 and {"the", "neither", "used", "whom"} <= STOPWORDS


@pytest.mark.parametrize("a,b,most,near", [("cat", "car", 1, True), ("cat", "cast", 1, True), ("kitten", "sitting", 3, True), ("kitten", "sitting", 2, False), ("abcdefgh", "xyz", 2, False), ("", "abc", 3, True), ("hello", "hxxlo", 2, True), ("hello", "xxxxx", 2, False), ("ab", "ba", 1, False)])
def test_edit_distance(spark, a, b, most, near):
    assert spark.range(1).select(within_distance(F.lit(a), F.lit(b), most).alias("x")).first()["x"] is near


def test_distance_by_length(spark):
    assert [fuzzy_distance(n, 2) for n in (3, 4, 6, 7, 20)] == [0, 1, 1, 2, 2]
    assert [fuzzy_distance(n, 1) for n in (3, 4, 7)] == [0, 1, 1] and fuzzy_distance(9, 0) == 0
    assert [r[0] for r in spark.range(3, 9).select(fuzzy_distance_column(F.col("id"), 2)).collect()] == [fuzzy_distance(n, 2) for n in range(3, 9)]


def test_flatten(spark):
    schema = "s struct<a: array<string>, b: struct<x: double, y: boolean>, m: map<string, int>, t: timestamp, n: decimal(6,2), z: string>"
    df = spark.sql("select array('p', '', null, 'q') a, 5.0D x, 2.5D y, true b, map('k', 7) m, timestamp'2024-01-02 03:04:05.006' t, cast(3 as decimal(6,2)) n")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    row = df.select(*(flatten(F.col(c), kinds[c]).alias(c) for c in df.columns)).first()
    assert list(row) == ["p q", "5", "2.5", "true", "7", "2024-01-02T03:04:05.006Z", "3"]
    nested = spark.createDataFrame([((["u", None], (1.0, False), {"k": 2}, None, None, None),)], schema)
    assert nested.select(flatten(F.col("s"), nested.schema["s"].dataType)).first()[0] == "u 1 false 2"


def test_numbers_and_dates(spark):
    n = lambda v: spark.range(1).select(number_of(F.lit(v), T.StringType())).first()[0]
    assert n("") == 0 and n(" ") == 0 and n("12.5") == 12.5 and n("x") is None
    d = lambda v: spark.range(1).select(F.date_format(date_of(F.lit(v), T.StringType() if isinstance(v, str) else T.LongType()), "yyyy-MM-dd")).first()[0]
    assert d("2024-02-03T00:00:00Z") == "2024-02-03" and d("nonsense") is None and d(86_400_000) == "1970-01-02"


def test_config():
    c = IndexConfig.of({"a": {"weight": 2.0, "path": "x.y"}, "b": {}}, id_col="key", k1=2.0)
    assert IndexConfig.from_dict(c.to_dict()) == c
    with pytest.raises(ValueError):
        IndexConfig.of([])
    assert math.isclose(IndexConfig.of(["a"]).k1, 1.2)
