"""The corpus pipeline: language ID, near-duplicate removal, decontamination, mixing and sharding of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftwork.llm import common, decontaminate, language, mixing, near_dup, sharding


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with enough confidence stay."""
    return language.keep_identified(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id: groups of verified similarity 0.8 in five-word shingles."""
    return near_dup.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item stay."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, in the order of training."""
    return mixing.mix(docs).select(*docs.columns)


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All records with their shard and slot; columns of those names that the documents had are replaced."""
    out = sharding.shard(docs.drop("shard", "grown_shard", "slot"), shards=16)
    return out.withColumnsRenamed({"__shard": "shard", "__grown": "grown_shard", "__slot": "slot"})


STAGES = [
    ("language", identify_language),
    ("near_duplicates", remove_near_duplicates),
    ("decontaminate", decontaminate_benchmark),
    ("mix", mix_sources),
    ("shard", shard_documents),
]

#: SQL can express neither the SimHash components nor the trained language model; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents; each stage's result is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.stage(docs, name)
    return docs
