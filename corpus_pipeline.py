"""Raw documents to packed training sequences: toxicity, near copies, secrets, mixture, packing.

Every stage takes any table with the columns of `documents`, more columns too, whatever they are called. Rows with a null doc_id or text pass all stages
but the draw of the mixture, which any row may fail; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import mixing, near, packing, secrets, toxicity
from lodestone.llm.stash import Stash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the toxicity classifier doesn't reject."""
    return toxicity.without_toxic(docs, _labels(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies; rows without doc_id or text stay."""
    return near.without_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets replaced in the text."""
    return secrets.without_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its rate asks for; a row may come more than once, or not at all."""
    return mixing.mixed(docs, _labels(spark, sf_dir))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of token ids: (grp, bin, n_tokens, doc_ids, first_tokens, offsets, input_ids)."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can express none of the five stages' models and sketches; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed documents; what each stage leaves is written to the shared folder and read again by the next."""
    stash = Stash(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stash.put(stage(spark, docs, sf_dir))
    return stash.last(STAGES[-1][1](spark, docs, sf_dir))
