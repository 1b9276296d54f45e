"""Indexes on disk, and as JSON."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import IndexConfig
from lodestone.functions.analysis import local
from lodestone.plans.index import SearchIndex

MANIFEST = "manifest.json"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside its place and renames it over what is there, in one step, so that a reader sees the old one or the new one."""
    own = f"{path}.{uuid.uuid4().hex}"
    fs, part = _fs(spark, own)
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    _rename(spark, own, path)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    """Renames a file over what is there, in one step."""
    fs, p = _fs(spark, new)
    _, part = _fs(spark, old)
    hadoop, sc = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext
    rename = getattr(hadoop, "Options$Rename")
    how = sc._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(p), how)


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def _manifest(spark: SparkSession, path: str) -> dict[str, Any]:
    manifest = json.loads(_read_text(spark, f"{path}/{MANIFEST}"))
    if "version" not in manifest:
        raise ValueError(f"{path} has no index: the manifest has no version")
    return manifest


def _with_postings(spark: SparkSession, config: IndexConfig, at: str) -> SearchIndex:
    """The index whose documents and tokens are written at `at`, once its postings are too.

    These are partitioned by field and sorted by term within files, so that a query reads the row groups of its terms.
    """
    docs, tokens = spark.read.parquet(f"{at}/docs"), spark.read.parquet(f"{at}/tokens")
    made = SearchIndex(spark, config, docs, tokens).postings
    made.repartitionByRange("field", "term").sortWithinPartitions("field", "term", "doc_id").write.partitionBy("field").parquet(f"{at}/postings")
    return SearchIndex(spark, config, docs, tokens, postings=spark.read.schema(made.schema).parquet(f"{at}/postings"))


def save(index: SearchIndex, path: str) -> None:
    """Writes documents, tokens, postings and dictionary as Parquet into a new folder of `path`, and then the manifest that names it.

    The manifest also has the statistics that scores need.
    """
    spark, at = index.spark, f"snapshot-{uuid.uuid4().hex}"
    index.docs.write.parquet(f"{path}/{at}/docs")
    index.tokens.write.parquet(f"{path}/{at}/tokens")
    written = _with_postings(spark, index.config, f"{path}/{at}")
    written.dictionary.sortWithinPartitions("field", "term").write.parquet(f"{path}/{at}/dictionary")
    top = written.docs.agg(F.max("seq")).first()[0]
    updated = index.last_updated.isoformat() if index.last_updated else None
    _write_text(spark, f"{path}/{MANIFEST}", json.dumps({"version": 1, "snapshot": at, "segments": [], "lastUpdated": updated, "statistics": written.statistics(), "top": top, "config": index.config.to_dict()}))


def append(spark: SparkSession, path: str, new: DataFrame, gone: DataFrame, config: IndexConfig | None = None) -> int:
    """Adds the documents `new` to the index saved at `path` and removes the ids `gone` (doc_id), and says how many segments it has then.

    Only what changes is written, as a segment: the new documents with their tokens and postings, the ids that it takes the place of, and by how much the
    document counts of terms change. What the index has is read for the documents that go, and not written anew; save() of the loaded index does that.
    """
    manifest, index = _manifest(spark, path), load(spark, path, config)
    at = f"segment-{uuid.uuid4().hex}"
    seq = F.monotonically_increasing_id() + F.lit(0 if manifest.get("top") is None else manifest["top"] + 1)
    SearchIndex._documents(new, index.config, seq, False).write.parquet(f"{path}/{at}/docs")
    SearchIndex._tokenised(spark.read.parquet(f"{path}/{at}/docs"), index.config).write.parquet(f"{path}/{at}/tokens")
    made = _with_postings(spark, index.config, f"{path}/{at}")
    gone.select("doc_id").unionByName(made.docs.select("doc_id")).distinct().write.parquet(f"{path}/{at}/gone")
    ids = spark.read.parquet(f"{path}/{at}/gone")
    count = lambda df, sign: df.groupBy("field", "term").agg((sign * F.count("*")).alias("df"))
    change = count(index.postings.join(ids, "doc_id", "left_semi"), -1).unionByName(count(made.postings, 1)).groupBy("field", "term").agg(F.sum("df").alias("df")).filter("df <> 0")
    change.select("field", "term", F.char_length("term").alias("term_len"), "df").sortWithinPartitions("field", "term").write.parquet(f"{path}/{at}/dictionary")
    sums = lambda df: {r["field"]: r["s"] for r in df.groupBy("field").agg(F.sum(F.size("tokens")).alias("s")).collect()}
    old, less, more = index.statistics(), sums(index.tokens.join(ids, "doc_id", "left_semi")), sums(made.tokens)
    n = old[""] - index.docs.join(ids, "doc_id", "left_semi").count() + made.docs.count()
    total = {f: (old[f] * old[""] if old[""] else 0) - less.get(f, 0) + more.get(f, 0) for f in index.config.fields}
    manifest["statistics"] = {"": n} | {f: round(t) / n if n else 1.0 for f, t in total.items()}
    manifest["top"] = max((x for x in (manifest.get("top"), made.docs.agg(F.max("seq")).first()[0]) if x is not None), default=None)
    manifest["segments"] = [*manifest.get("segments", []), at]
    manifest["lastUpdated"] = datetime.now(timezone.utc).isoformat()
    _write_text(spark, f"{path}/{MANIFEST}", json.dumps(manifest))
    return len(manifest["segments"])


def load(spark: SparkSession, path: str, config: IndexConfig | None = None) -> SearchIndex:
    """The index saved at `path`; its settings are those saved unless others are given, as they must be if columns or functions were among them.

    Of a document that several segments have the last counts, and none if a later one removes it.
    """
    manifest = _manifest(spark, path)
    own = config or IndexConfig.from_dict(manifest["config"])
    updated = datetime.fromisoformat(manifest["lastUpdated"]) if manifest.get("lastUpdated") else None
    parts = [f"{path}/{x}" for x in (manifest["snapshot"], *manifest.get("segments", []))]
    base = {n: spark.read.parquet(f"{parts[0]}/{n}") for n in ("docs", "tokens", "postings", "dictionary")}
    made = SearchIndex(spark, own, base["docs"], base["tokens"], updated, base["postings"], base["dictionary"], manifest.get("statistics"))
    if len(parts) == 1:
        return made
    union = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    gone = union([spark.read.parquet(f"{x}/gone").withColumn("last", F.lit(i)) for i, x in enumerate(parts) if i]).groupBy("doc_id").agg(F.max("last").alias("last"))

    def live(name: str) -> DataFrame:
        rows = union([spark.read.schema(base[name].schema if name != "docs" else spark.read.parquet(f"{x}/docs").schema).parquet(f"{x}/{name}").withColumn("segment", F.lit(i)) for i, x in enumerate(parts)])
        return rows.join(gone, "doc_id", "left").filter("last is null or segment >= last").drop("segment", "last")

    terms = union([base["dictionary"], *(spark.read.schema(base["dictionary"].schema).parquet(f"{x}/dictionary") for x in parts[1:])])
    terms = terms.groupBy("field", "term", "term_len").agg(F.sum("df").alias("df")).filter("df > 0")
    return SearchIndex(spark, own, live("docs"), live("tokens"), updated, live("postings"), terms, manifest.get("statistics"))


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes the snapshots and segments at `path` that the manifest doesn't name, and says how many; readers of old ones must be done."""
    manifest = _manifest(spark, path)
    kept = {manifest["snapshot"], *manifest.get("segments", [])}
    fs, p = _fs(spark, path)
    old = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName().startswith(("snapshot-", "segment-")) and f.getPath().getName() not in kept]
    for x in old:
        fs.delete(x, True)
    return len(old)


def _head(index: SearchIndex) -> str:
    """The JSON text of an index up to its documents."""
    return json.dumps({"version": 1, "createdAt": datetime.now(timezone.utc).isoformat(), "config": index.config.to_dict(), "documents": []}, ensure_ascii=False).removesuffix("]}")


def serialized_lines(index: SearchIndex) -> DataFrame:
    """(value): the lines of the JSON text of an index, in order, made by the tasks: what comes before the documents, a document each, and the end."""
    first = index.docs.agg(F.min("seq")).first()[0]
    text = F.to_json("doc", {"ignoreNullFields": "false"})
    documents = index.docs.select(F.lit(1).alias("part"), "seq", F.when(F.col("seq") == F.lit(first), text).otherwise(F.concat(F.lit(","), text)).alias("value"))
    ends = local(index.spark, "part int, seq long, value string", [(0, 0, _head(index)), (2, 0, "]}")])
    return ends.unionByName(documents).orderBy("part", "seq").select("value")


def deserialized_lines(lines: DataFrame, config: IndexConfig, schema: Any = None) -> SearchIndex:
    """The index of such lines, read by the tasks."""
    spark = lines.sparkSession
    documents = lines.filter(F.col("value").rlike(r"^,?\{") & F.col("value").endswith("}")).select(F.regexp_replace("value", "^,", "").alias("value"))
    reader = spark.read if schema is None else spark.read.schema(schema)
    strings = getattr(documents._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return SearchIndex.build(DataFrame(reader._jreader.json(strings), spark), config)


def serialize(index: SearchIndex) -> str:
    """An index as one JSON text on the driver, for indexes that fit there; serialized_lines() and save_to_file() make the same without it."""
    return "\n".join(r["value"] for r in serialized_lines(index).toLocalIterator())


def deserialize(spark: SparkSession, text: str, config: IndexConfig, schema: Any = None) -> SearchIndex:
    """The index of a JSON text under the given settings. Dates stay texts unless `schema` says otherwise."""
    data = json.loads(text)
    if "version" not in data:
        raise ValueError("this is no exported index: it has no version")
    lines = spark.sparkContext.parallelize([json.dumps(d) for d in data["documents"]])
    reader = spark.read if schema is None else spark.read.schema(schema)
    return SearchIndex.build(reader.json(lines), config)


def save_to_file(index: SearchIndex, path: str) -> None:
    """serialized_lines() in a file of any file system that Spark knows. Tasks write its parts beside it; the driver copies their bytes one after the other."""
    spark, own = index.spark, f"{path}.{uuid.uuid4().hex}"
    serialized_lines(index).write.text(f"{own}.parts")
    fs, parts = _fs(spark, f"{own}.parts")
    io = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils
    out = fs.create(_fs(spark, own)[1], True)
    try:
        for name in sorted(f.getPath().getName() for f in fs.listStatus(parts) if f.getPath().getName().startswith("part-")):
            part = fs.open(_fs(spark, f"{own}.parts/{name}")[1])
            io.copyBytes(part, out, 1 << 20, False)
            part.close()
    finally:
        out.close()
    _rename(spark, own, path)
    fs.delete(parts, True)


def load_from_file(spark: SparkSession, path: str, config: IndexConfig, schema: Any = None) -> SearchIndex:
    """The index of such a file, read by the tasks; a JSON text laid out in another way is read by the driver."""
    lines = spark.read.text(path)
    top = lines.head()
    if top is not None and top["value"].startswith('{"version": ') and top["value"].endswith('"documents": ['):
        return deserialized_lines(lines, config, schema)
    return deserialize(spark, _read_text(spark, path), config, schema)
