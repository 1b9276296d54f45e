"""The pipeline's stages, each by what it must do to its own input."""

from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from lodestone.llm import mixing, packing, secrets, toxicity
from test_operators import unpacked, whole_texts

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_names_and_columns(spark, stages):
    assert list(stages) == ["toxicity", "near_dedup", "secret_scans", "mixing", "packing"]
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(after.columns == columns for name, (_, after) in stages.items() if name != "packing")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_toxic_go(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = [(i, t) for i, t in rows_of(before) if brute.toxicity_of(model, t or "") >= 0.5]
    assert bad and sorted(rows_of(after) + bad) == sorted(rows_of(before))


def test_one_of_each_group_stays(stages):
    before, after = stages["near_dedup"]
    rows = rows_of(before)
    found = brute.groups(rows)
    want = {}
    for (d, t), (first, group) in found.items():
        if d == first:
            want.setdefault(group, []).append((d, t))
    assert len(want) < len(rows)
    got = rows_of(after)
    assert len(got) == len(want) and all(sum(x in own for x in got) == 1 for own in want.values())


def test_secrets_go_and_documents_stay(stages):
    before, after = stages["secret_scans"]
    model = secrets.default_model()
    want = sorted((i, brute.redacted(model, t)) for i, t in rows_of(before))
    assert sorted(rows_of(after)) == want and any("<SECRET>" in t for _, t in want)


def test_mixture_draws_by_the_rates(spark, stages):
    before, after = stages["mixing"]
    rows, drawn = rows_of(before), Counter(rows_of(after))
    _, rate = brute.rates_of(mixing.train(before, spark.read.parquet(f"{SF}/labels.parquet")), [t for _, t in rows])
    assert set(drawn) <= set(rows) and len(set(rows)) == len(rows)
    assert all(np.floor(x - 1e-6) <= drawn[row] <= np.floor(x + 1e-6) + 1 for row, x in zip(rows, rate))
    assert abs(sum(drawn.values()) - rate.sum()) < 4 * np.sqrt(len(rows))


def test_packing_has_every_row(stages):
    before, after = stages["packing"]
    texts = {}
    for r in before.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    pieces, bins = unpacked(after.collect())
    assert whole_texts(pieces) == {i: t[0] for i, t in texts.items()}
    assert {i: len(p) for (i, f), p in pieces.items() if f == 0} == {i: len(t) for i, t in texts.items()}
    assert all(sum(b) <= packing.CAPACITY for own in bins.values() for b in own.values())


def awkward_docs(spark):
    rows = [(1, "a few words"), (1, "a few words"), (2, "a few words"), (None, "no id"), (3, None), (None, None), (4, ""), (5, "w " * 30000), (6, "other text"), (6, "unlike it")]
    clash = ("score", "__toxicity", "toxicity", "digest", "__rate", "grp", "c0", "tokens")
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in clash})


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_awkward_tables(spark, tmp_path, empty):
    docs = awkward_docs(spark).limit(0) if empty else awkward_docs(spark)
    columns, n = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "packing" or docs.columns == columns
        n.append(docs.count())
    assert n[:3] == ([0, 0, 0] if empty else [10, 8, 8]) and (n[4] == 0) == empty


def test_run_is_registered(spark):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, SF).count() > 0
