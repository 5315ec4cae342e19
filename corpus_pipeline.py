"""A training corpus from the documents: toxic and bad texts go, one of each class of near copies stays, sources are mixed, the rest is packed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import mixing, ngram_join, packing, quality_nbsvm, toxicity
from quarry.llm.common import durable, fold, release, table
from quarry.llm.queries import EPOCHS, SEED, WEIGHTS, vocabulary


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = toxicity.learn_toxicity(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return toxicity.drop_toxic(docs, net)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_nbsvm.learn_quality(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return quality_nbsvm.keep_good(docs, model)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_each(docs)


def in_proportion(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, WEIGHTS, EPOCHS, SEED)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("quality classifier", of_quality),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources to target weights", in_proportion),
    ("best-fit packing", packed),
]

#: The stages are trained models, a similarity join and a search, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written as Parquet and read again as the next one's documents; it goes once the next is written, the last when the driver ends."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs, before = durable(stage(spark, docs, sf_dir)), docs
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
