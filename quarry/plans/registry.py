"""The registry of queries by name, and of the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import time
from quarry.plans.flagship import flagship

QUERIES = {"document_profile": flagship}
SQL = {
    "document_profile": """
WITH f AS (SELECT lang, md5(text) AS digest, count(*) AS copies, min(doc_id) AS kept_id, first(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1, 2)
SELECT lang, sum(copies)::BIGINT AS documents, count(*) AS distinct_texts, sum(bytes)::BIGINT AS kept_bytes, sum(bytes * (copies - 1))::BIGINT AS saved_bytes, min(kept_id) AS first_id FROM f GROUP BY lang
""",
}


def query(table: str, sql: str | None = None):
    """Registers a function of (table as DataFrame, reader of other tables) as a query."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
            return f(read(table), read)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def utc(c: str):
    """The instant of a column of times without zone, which are UTC."""
    return time.from_wall(F.col(c))
