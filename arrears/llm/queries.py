"""The text operators' registered queries: each applies its operator to its
whole table with production parameters. ``ORACLE_SQL`` has the same result in
DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arrears.llm import chat, collocations, decontam, jaccard, langid, licenses, mixing, packing, quality, simhash, simplex, urls, warc
from arrears.llm import oracles
from arrears.sources.tables import read_table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark, read_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(spark, read_table(spark, sf_dir, "pages", "page_id", "url"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return jaccard.jaccard_components(spark, docs, k=4, num=85, den=100)


def op3_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return jaccard.jaccard_join(spark, docs, k=4, num=85, den=100)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat(spark, read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(spark, read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.quality(spark, docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return decontam.contamination(spark, docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def proximity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return decontam.proximity(spark, docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprints(spark, read_table(spark, sf_dir, "documents", "doc_id", "text"))


def simhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_documents(spark, read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(spark, read_table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack_documents(spark, docs, public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark, read_table(spark, sf_dir, "documents", "text", "lang"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simplex.cluster(spark, read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")).drop("v", "n_compared")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_warc, op2_url_filter, op3_jaccard_join, op3_jaccard_links, op4_chat, op5_mixing, op6_license_scan, op7_quality, op8_decontaminate, op9_simhash, simhash_near, proximity_matches, op10_language_id, op11_packing, op12_collocations, op13_clustering)}

ORACLE_SQL: dict[str, str] = {"op4_chat": chat.ORACLE_SQL, "op5_mixing": mixing.ORACLE_SQL, "op6_license_scan": licenses.ORACLE_SQL} | oracles.ORACLE_SQL
