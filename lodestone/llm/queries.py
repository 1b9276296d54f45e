"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import chat, graph, mixing, near, packing, repeats, secrets, toxicity, urls, vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nearest_neighbours(table(spark, sf_dir, "embeddings"), every=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_url_filters": op2_url_filters,
    "op3_secret_scans": op3_secret_scans,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_packing": op7_packing,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_approximate_nearest_neighbours": op10_approximate_nearest_neighbours,
}

OP1_SQL = r"""
with texts as (
    select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[0-9a-z_]|[^\x00-\x7F])+') as w
    from documents where doc_id is not null and text is not null
), starts as (
    select doc_id, w, unnest(range(1, len(w) - 48)) as i from texts where len(w) >= 50
), windows as (
    select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from starts
), shared as (
    select h from windows group by h having count(distinct doc_id) > 1
), hits as (
    select distinct doc_id, i from windows semi join shared using (h)
), islands as (
    select doc_id, i, sum(fresh) over (partition by doc_id order by i) as island
    from (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as fresh from hits)
)
select doc_id, min(i) - 1 as first_word, max(i) + 50 - min(i) as n_words from islands group by doc_id, island
"""

OP5_SQL = """
with recursive vectors as (
    select *, row_number() over (order by vec_id, e) as r
    from (select distinct vec_id, embedding::double[] as e from embeddings where vec_id is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))) and list_bool_or(list_transform(embedding, lambda x: x <> 0)))
), links as (
    select a.r as a, b.r as b from vectors a join vectors b on a.r <> b.r and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9
), reach as (
    select r, r as s from vectors union select reach.r, links.b from reach join links on links.a = reach.s
), classes as (
    select reach.r, min(v.vec_id) as class_id from reach join vectors v on v.r = reach.s group by reach.r
)
select vec_id, class_id, (select count(*) from links where links.a = r) as n_links from vectors join classes using (r)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op2_url_filters": urls.oracle_sql(),
    "op5_embedding_near_dedup": OP5_SQL,
}
