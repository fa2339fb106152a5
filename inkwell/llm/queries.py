"""Queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import decontam, html_extract, langid, packing, quality, sharding, simhash, tokencodec, topk, toxicity
from inkwell.llm.common import load


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.hits(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return toxicity.flagged(docs, toxicity.train(docs, load(spark, sf_dir, "labels")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    return html_extract.extracted(pages, html_extract.train(pages))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return topk.search(docs, docs.where(F.col("doc_id") % topk.ONE_IN == 0).select(F.col("doc_id").alias("query_id"), "text"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.duplicates(load(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, load(spark, sf_dir, "labels")))


def op9_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencodec.write_blocks(load(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_packing,
        op2_decontamination,
        op3_toxicity,
        op4_html_extraction,
        op5_topk_search,
        op6_simhash_dedup,
        op7_language_id,
        op8_quality,
        op9_token_blocks,
        op10_sharding,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": decontam.sql(), "op5_topk_search": topk.sql(), "op10_sharding": sharding.sql()}
