"""The registered queries of this package, one opN_<name> for each operator. The pipeline is the driver contract's to add."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import co_training, crf_langid, decontamination, jaccard_join, mixing, ngram_lm, oracles, page_text, pii, quality_rules, secret_scan
from tidemark.ship import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op1(_table(spark, sf_dir, "documents"))


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.op2(_table(spark, sf_dir, "documents"))


def op3_crf_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_langid.op3(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op4(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.op5(_table(spark, sf_dir, "pages"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.op6(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.op7(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op8(_table(spark, sf_dir, "documents"))


def op9_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co_training.op9(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op10(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii, op2_ngram_lm, op3_crf_langid, op4_quality_rules, op5_page_text, op6_jaccard_join, op7_decontamination,
        op8_secret_scan, op9_co_training, op10_mixing,
    )
}
ORACLES: dict[str, str] = {"op1_pii": oracles.OP1, "op8_secret_scan": oracles.OP8, "op10_mixing": mixing.ORACLE}
