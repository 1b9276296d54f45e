"""A stream of changes applied to a saved index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lodestone.config import IndexConfig
from lodestone.plans.index import SearchIndex
from lodestone.sources.storage import append

UPSERTS, REMOVALS = ("insert", "add", "update", "upsert"), ("delete", "remove")


def last_changes(changes: DataFrame, op: str = "op", doc_id: str = "doc_id", ts: str = "ts") -> DataFrame:
    """The last change of each document; of changes at one time a removal counts, and else the greatest operation."""
    latest = W.partitionBy(doc_id).orderBy(F.desc(ts), F.lower(op).isin(*REMOVALS).desc(), F.desc(op))
    return changes.withColumn("__n", F.row_number().over(latest)).filter("__n = 1").drop("__n")


def _split(changes: DataFrame, op: str, doc_id: str, ts: str, doc: str) -> tuple[DataFrame, DataFrame]:
    """(new documents, ids that go) of the last changes."""
    last = last_changes(changes, op, doc_id, ts)
    gone = last.filter(F.lower(op).isin(*REMOVALS)).select(F.col(doc_id).cast("string").alias("doc_id"))
    return last.filter(F.lower(op).isin(*UPSERTS)).select(f"{doc}.*"), gone


def apply_changes(index: SearchIndex, changes: DataFrame, op: str = "op", doc_id: str = "doc_id", ts: str = "ts", doc: str = "doc") -> SearchIndex:
    """The index after (op, doc_id, ts, doc) changes; operations are insert, add, update, upsert, delete and remove."""
    new, gone = _split(changes, op, doc_id, ts, doc)
    return index.remove_all(gone).add_many(new)


def start_upserts(stream: DataFrame, path: str, checkpoint: str, config: IndexConfig | None = None, op: str = "op", doc_id: str = "doc_id", ts: str = "ts", doc: str = "doc", segments: int = 16, **trigger) -> StreamingQuery:
    """Runs a stream of changes into the index saved at `path`.

    A batch appends the last change of each document as a segment, and writes the index anew only when it has `segments` of them. The manifest names
    what there is at the end, so that readers never see half a batch, and a batch that is run again gives the same documents.
    """

    def batch(changes: DataFrame, _: int) -> None:
        spark: SparkSession = changes.sparkSession
        if changes.isEmpty():
            return
        new, gone = _split(changes, op, doc_id, ts, doc)
        if append(spark, path, new, gone, config) >= segments:
            SearchIndex.load(spark, path, config).save(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
