"""The corpus pipeline: language ID, SimHash near-dedup, surrogates for personal data, source mixing, best-fit packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm.common import written
from vantage.llm.langid import identify
from vantage.llm.mixing import weigh
from vantage.llm.packing import pack_documents
from vantage.llm.pii import replace
from vantage.llm.simhash import survivors


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: those without a letter and those scored under the calibrated least."""
    return identify(docs).where("not rejected").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays: a row of its least doc_id. Ids may repeat or be null."""
    return survivors(docs).select(docs.columns)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets in the texts are replaced; n_chars follows the text."""
    out = replace(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by the probabilities to which the raked weights are calibrated."""
    return weigh(docs).where("kept").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, with the sequence and offset of each."""
    return pack_documents(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("surrogates", surrogates), ("mixing", mixing), ("packing", packing)]

#: Learned, iterative and genetic stages aren't SQL; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
