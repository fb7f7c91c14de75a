"""From raw documents to training shards: the stages and their run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import excise
from .jaccard import keep_one
from .language import keep_identified
from .mixing import in_order
from .queries import SOURCE_WEIGHTS, table
from .shared import materialise, release, text_batches
from .sharding import in_shards


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those that the models reject go."""
    text_batches(spark)
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    text_batches(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is nothing else goes."""
    text_batches(spark)
    return excise(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in the order of the mixture of sources."""
    return in_order(docs, SOURCE_WEIGHTS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their training shard, sorted by shard and then in the order of the mixture;
    a column `shard` of the input is replaced."""
    return in_shards(docs, SOURCE_WEIGHTS, slot=False)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Language models and removal spans are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each one's rows written and read again by the next.

    The result also has `slot`, the row's place in its shard in the order of the mixture: Spark
    does not read the files of a table in their order.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        release(spark)
    docs = materialise(in_shards(docs, SOURCE_WEIGHTS), STAGES[-1][0])
    release(spark)
    return docs
