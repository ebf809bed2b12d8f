"""The queries of this package and, where SQL can express them, their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm import (
    alignment, checks, decontamination, html, lm, mixing, packing, quality, secrets, simhash, topk, urls, warc, whitening,
)
from casebook.session import apply_settings

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    apply_settings(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(_table(spark, folder, "documents"))
    return judged.select("doc_id", *quality.BASE_COUNTS, "base_failed", "kept")


def op3_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents"))


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_table(spark, folder, "pages"))


def op5_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, folder, "documents")))


def op7_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(_table(spark, folder, "documents"))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.derive(warc.responses(_table(spark, folder, "pages")))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op10_html(spark: SparkSession, folder: str) -> DataFrame:
    return html.main_text(_table(spark, folder, "pages"))


def op11_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.digest(decontamination.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark")))


def op12_whiten(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


def op13_align(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.alignment(_table(spark, folder, "documents"))


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in (
        op1_pack, op2_quality_rules, op3_mix, op4_url_filter, op5_topk, op6_secrets, op7_lm_score, op8_warc, op9_simhash, op10_html,
        op11_decontaminate, op12_whiten, op13_align,
    )}


def oracle_sql() -> dict[str, str]:
    return dict(checks.SQL)
