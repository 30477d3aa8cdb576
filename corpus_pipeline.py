"""The corpus pipeline: stages over ``documents``, in order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of ``docs``:
language ID drops documents whose language is undetermined or uncertain, line dedup cuts repeated
lines out of texts, near-dedup keeps one document of each group whose SimHash fingerprints (of
three-word shingles) are connected by steps of at most three differing bits, decontamination drops
documents that hold benchmark passages, and mixing samples by calibrated probabilities.

For every stage: an empty table gives an empty one, other columns travel along whatever their
names, repeated rows are decided alike, and texts are read whole, however long. Null and empty
texts have no language and go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slicewise.llm import decontam, langid, linededup, mixing, simhash
from slicewise.sinks.tables import landed


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language; null, empty and letterless texts go."""
    return langid.keep_known(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier one; documents of blanks only go."""
    return linededup.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component of fingerprints."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontam.drop_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the probability of their cell; rows with one id are drawn together."""
    return mixing.sample(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

#: Model fitting, connected components and edit distance are beyond one statement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
