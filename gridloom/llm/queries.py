"""The thirteen operators over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import ctw_score, hard_negatives, langid, license_scan, line_quality, mixing, packing, phrases, pii, secret_scan, simhash_dedup, topk_search, warc
from gridloom.llm._shared import documents


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(documents(spark, sf_dir))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.report(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(documents(spark, sf_dir))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(documents(spark, sf_dir))


def op9_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw_score.report(documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.report(documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_pii, op2_license_scan, op3_secrets, op4_quality, op5_mixing, op6_topk, op7_langid, op8_packing, op9_ctw, op10_simhash, op11_hard_negatives, op12_warc, op13_phrases)}
#: The other operators are beyond SQL and are tested against brute force.
ORACLES = {
    "op4_quality": line_quality.ORACLE, "op6_topk": topk_search.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE, "op12_warc": warc.ORACLE, "op13_phrases": phrases.ORACLE,
}
