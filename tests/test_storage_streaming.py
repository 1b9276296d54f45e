import json

import pytest
from pyspark.sql import functions as F

from lodestone import IndexConfig, SearchIndex
from lodestone.sources.storage import deserialize, load_from_file, save_to_file, serialize, vacuum
from lodestone.streaming.upserts import apply_changes, start_upserts

SCHEMA = "id string, title string, n double"


@pytest.fixture(scope="module")
def index(spark):
    return SearchIndex.build(spark.createDataFrame([("1", "red shoes", 1.0), ("2", "blue shoes", 2.5), ("3", "mat", None)], SCHEMA), {"title": {"weight": 2.0}}, k1=1.5)


def hits(i, q="shoes"):
    return [(r["doc_id"], round(r["raw_score"], 6)) for r in i.search(q, highlight=False).hits.collect()]


def test_save_and_load(spark, tmp_path, index):
    index.save(str(tmp_path / "x"))
    back = SearchIndex.load(spark, str(tmp_path / "x"))
    assert hits(back) == hits(index) and back.config == index.config and back.last_updated == index.last_updated
    index.remove("1").save(str(tmp_path / "x"))
    assert [h[0] for h in hits(SearchIndex.load(spark, str(tmp_path / "x")))] == ["2"]
    assert vacuum(spark, str(tmp_path / "x")) == 1 and vacuum(spark, str(tmp_path / "x")) == 0
    assert [h[0] for h in hits(SearchIndex.load(spark, str(tmp_path / "x")))] == ["2"]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "manifest.json").write_text("{}")
    with pytest.raises(ValueError):
        SearchIndex.load(spark, str(tmp_path / "bad"))


def test_json_envelope(spark, tmp_path, index):
    data = json.loads(serialize(index))
    assert data["version"] == 1 and len(data["documents"]) == 3 and data["documents"][2] == {"id": "3", "title": "mat", "n": None}
    assert hits(deserialize(spark, serialize(index), index.config)) == hits(index)
    data["version"] = 99
    assert hits(deserialize(spark, json.dumps(data), IndexConfig.of(["title"], k1=1.5), SCHEMA)) != []
    del data["version"]
    with pytest.raises(ValueError):
        deserialize(spark, json.dumps(data), index.config)
    save_to_file(index, str(tmp_path / "f.json"))
    assert hits(load_from_file(spark, str(tmp_path / "f.json"), index.config)) == hits(index)
    e = index.export()
    assert hits(SearchIndex.import_(e["documents"], index.config)) == hits(index) and e["config"]["k1"] == 1.5


def test_changes_and_stream(spark, tmp_path, index):
    rows = [("insert", "4", 1, ("4", "green shoes", 4.0)), ("update", "1", 2, ("1", "red hat", 1.0)), ("delete", "2", 3, None), ("update", "5", 1, ("5", "old shoes", 5.0)), ("delete", "5", 2, None), ("remove", "3", 1, None), ("add", "3", 2, ("3", "new mat shoes", 3.0))]
    changes = spark.createDataFrame(rows, f"op string, doc_id string, ts int, doc struct<{SCHEMA.replace(' string', ': string').replace(' double', ': double')}>")
    want = hits(apply_changes(index, changes))
    assert {h[0] for h in want} == {"4", "3"}
    index.save(str(tmp_path / "i"))
    changes.filter("ts < 2").coalesce(1).write.parquet(str(tmp_path / "in"))
    for step in (1, 2):
        stream = spark.readStream.schema(changes.schema).parquet(str(tmp_path / "in"))
        q = start_upserts(stream, str(tmp_path / "i"), str(tmp_path / "checkpoint"))
        q.awaitTermination()
        if step == 1:
            assert {h[0] for h in hits(SearchIndex.load(spark, str(tmp_path / "i")))} == {"1", "2", "4", "5"}
            changes.filter("ts >= 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert hits(SearchIndex.load(spark, str(tmp_path / "i"))) == want
    back = SearchIndex.load(spark, str(tmp_path / "i"))
    assert back.docs.filter(F.col("doc_id").isin("2", "5")).isEmpty()
    again = apply_changes(index, changes)
    terms = lambda i: {(r["field"], r["term"], r["df"]) for r in i.dictionary.collect()}
    assert terms(back) == terms(again) and back.statistics() == again.statistics()
    assert len(json.loads((tmp_path / "i" / "manifest.json").read_text())["segments"]) == 2
    back.save(str(tmp_path / "i"))
    assert vacuum(spark, str(tmp_path / "i")) == 3 and hits(SearchIndex.load(spark, str(tmp_path / "i"))) == want


def test_segments_are_merged_in_time(spark, tmp_path, index):
    kind = f"struct<{SCHEMA.replace(' string', ': string').replace(' double', ': double')}>"
    index.save(str(tmp_path / "i"))
    for step in range(3):
        spark.createDataFrame([("update", "1", step, ("1", f"red shoes {step}", 1.0)), ("delete", "none", step, None)], f"op string, doc_id string, ts int, doc {kind}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(f"op string, doc_id string, ts int, doc {kind}").parquet(str(tmp_path / "in"))
        start_upserts(stream, str(tmp_path / "i"), str(tmp_path / "checkpoint"), segments=2).awaitTermination()
        got = SearchIndex.load(spark, str(tmp_path / "i"))
        assert got.get_by_id("1").first()["title"] == f"red shoes {step}" and got.statistics()[""] == 3
        assert len(json.loads((tmp_path / "i" / "manifest.json").read_text())["segments"]) == (step + 1) % 2
