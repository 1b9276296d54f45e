"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of 64-bit ids up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; where neither is set a new folder in local mode, and an error on a cluster."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if there is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = tempfile.mkdtemp(prefix="lodestone-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(there)
    return there


class Stash:
    """Tables written as Parquet under one folder of the shared directory, so that a lost executor costs nothing that is in them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/stash-{uuid.uuid4().hex}"
        self.n = 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        self._delete(self.base)

    def last(self, df: DataFrame) -> DataFrame:
        """The result as a table, after which the tables before it go; it stays until whoever owns the folder removes it."""
        out = self.put(df)
        for i in range(1, self.n):
            self._delete(f"{self.base}/{i}")
        return out

    def finish(self, df: DataFrame) -> DataFrame:
        """The result, checkpointed, after which the tables it was made from go. The checkpoint stays until Spark's cleaner or whoever owns the folder removes it."""
        out = df.checkpoint(eager=True)
        self.close()
        return out


def collect_garbage(spark: SparkSession) -> None:
    """Lets go of the shuffle files of plans that are no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(ids: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`ids` (a stashed table of narrow rows), marked for broadcast if it has few enough rows."""
    return F.broadcast(ids) if ids.count() <= rows else ids


def components(edges: DataFrame, stash: Stash) -> DataFrame:
    """(id, root): the smallest id of the connected component, for each id that `edges` (a, b) name.

    Alternates large-star and small-star rounds (Kiveris et al. 2014) until the edges stop changing. The smallest neighbour of a vertex is aggregated
    before the shuffle and joined back from a table, so that a vertex with many edges is split by the skew join.
    """

    def smallest(pairs: DataFrame) -> DataFrame:
        return stash.put(pairs.groupBy("u").agg(F.min("v").alias("m")))

    now = stash.put(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.filter("v > u").join(smallest(both), "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct()
        large = stash.put(large)
        low = smallest(large)
        star = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = stash.put(star.filter("u <> v").distinct())
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            break
        mark = tuple(new)
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()
