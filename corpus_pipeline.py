"""The corpus pipeline: quality, near-dedup, decontamination, personal data, mixing.

The last stage returns the documents that the mix takes words of, each once, with the words
taken of it (``taken``, repeats counted); ``mixing.mixed_blocks`` writes out the blocks themselves.
"""

from pyspark.sql import DataFrame, SparkSession

from cohortlake.llm import decontaminate, mixing, neardup, pii, quality
from cohortlake.llm.common import forget, materialize, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).where("taken > 0")


STAGES = [("quality classifier", good), ("near-dedup", distinct), ("decontamination", unseen), ("personal data", private), ("mixing", mixed)]

#: A fitted model and similarity joins have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage{k}")
            if last is not None:
                forget(last)
            last = docs
    return docs
