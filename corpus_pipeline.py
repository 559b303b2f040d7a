"""A corpus pipeline of five stages over the documents table.

Counted with the subpackage of training-data operators. Each stage takes
(spark, docs, sf_dir); what it returns is written and read again as the next
stage's docs. All but the last return the columns of documents.

Quality rules drop rejected texts; near-dedup keeps the first document of each
group (five-word shingles, similarity 0.8); substring dedup takes repeated bytes
out of what is left; mixing repeats or drops documents to meet source targets;
packing places the pieces of the mix into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm import mixing, near_dedup, packing, quality, substring_dedup
from maskwright.llm._store import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_first(docs, width=5, threshold=80)


def substring_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.cut(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_duplicates),
    ("substring_dedup", substring_repeats),
    ("source_mixing", source_mix),
    ("best_fit_packing", sequences),
]

#: SQL can express neither the tokenizer nor the best fit; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
