"""The corpus pipeline: documents to a deduplicated, decontaminated, mixed training set.

Every stage works on all that its predecessor kept. All stages but the last return the
columns of documents; the last adds copy_no, n_copies and mix_key and shuffles globally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm import decontaminate, mixing, quality_crf, simhash, substring_dedup
from sessionlens.llm.common import materialize, read_table


def _sized(docs: DataFrame) -> DataFrame:
    """Gives n_chars its value for the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the line field scores below its threshold."""
    labels = quality_crf.learning_rows(read_table(spark, sf_dir, "labels"))
    return quality_crf.drop_low_quality(docs, quality_crf.fit(docs, labels))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of copies and near copies."""
    return simhash.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that a document with a smaller id has."""
    return _sized(substring_dedup.drop_repeats(docs))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of the benchmark, and documents that mostly consist of them."""
    return _sized(decontaminate.remove_matches(docs, read_table(spark, sf_dir, "benchmark")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents to the sources' target shares and shuffles the copies."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", simhash_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("source mixing", mixing_stage),
]

#: Most stages can't be written in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
