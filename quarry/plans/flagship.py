"""The flagship query: a profile of the distinct documents of each language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: documents, distinct texts (the first doc_id of each digest is kept), their bytes and the share saved.

    The digest and size, not the text, are shuffled; counts are combined before the second shuffle.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slim = docs.select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    first = slim.groupBy("lang", "digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("kept_id"), F.first("bytes").alias("bytes"))
    return first.groupBy("lang").agg(
        F.sum("copies").alias("documents"), F.count(F.lit(1)).alias("distinct_texts"), F.sum("bytes").alias("kept_bytes"),
        F.sum(F.col("bytes") * (F.col("copies") - 1)).alias("saved_bytes"), F.min("kept_id").alias("first_id"),
    )
