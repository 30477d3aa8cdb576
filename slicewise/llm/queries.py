"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewise.llm import (chat, decontam, filteraudit, fingerprints, knn, langid, license, linededup, mixing, pii,
                           quality, simhash, whitening)
from slicewise.llm.common import read, register


@register
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read(spark, sf_dir, "documents"))


@register
def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@register
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)],
                                    "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(turns.unionByName(planted))


@register
def op5_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.digest(read(spark, sf_dir, "documents"))


@register
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = knn.integer_vectors(read(spark, sf_dir, "embeddings"))
    return knn.top_k(vectors.filter(F.col("vec_id") % 100 == 0), vectors)


@register
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read(spark, sf_dir, "documents"))


@register
def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(read(spark, sf_dir, "documents"))


@register
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(read(spark, sf_dir, "documents"))


@register
def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(read(spark, sf_dir, "documents"))


@register
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@register
def op11_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@register
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(whitening.integer_rows(read(spark, sf_dir, "embeddings")))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@register
def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(read(spark, sf_dir, "documents"))
