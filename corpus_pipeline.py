"""The corpus pipeline: language ID, near-deduplication, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm._common import materialize, table
from corvane.llm.decontaminate import drop_contaminated
from corvane.llm.lang_id import identify
from corvane.llm.mixing import mix_documents
from corvane.llm.near_sets import drop_similar
from corvane.llm.sharding import assign_shards


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told, with that language as ``lang``; those without a letter go."""
    found = identify(docs, carry=True).where("lang_pred <> 'und'")
    return found.withColumn("lang", found["lang_pred"]).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more over five-word shingles."""
    return drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words in a row with a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, each as often as the 5:2:1 mix of sources takes it."""
    return mix_documents(docs, emit=True)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes."""
    return assign_shards(docs, shards=8)


STAGES = [("language ID", language_id), ("near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: SQL cannot express the trees of the language stage; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialize(docs, f"stage{n}")
    return docs
