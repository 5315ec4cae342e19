"""Helpers shared by the operators: tables, folds, durable intermediate results, bounded labelled samples."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: ASCII white space.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
NO_WORDS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Shuffle files of a query go when it ends, not when the driver next collects its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where none is named, a local Spark gets a temporary one; a cluster is refused."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quarry-checkpoint-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and read back from a Parquet table in the shared folder. Not for use in parallel threads.

    So lineage is cut, and a lost executor costs no recomputation. Tables that nothing reads any more go by release(),
    those of a whole job by scratch(), and all others when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(TIDY, before)
    at, files = hadoop_path(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    for names in _scopes:
        names.append(path)
    return out


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, as Hadoop has them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """On leaving the scope, all tables go that durable() wrote in it; results that read them must have been used or written by then."""
    names: list[str] = []
    _scopes.append(names)
    try:
        yield
    finally:
        _scopes[:] = [x for x in _scopes if x is not names]
        for path in names:
            at, files = hadoop_path(spark, path)
            files.delete(at, True)
            files.cancelDeleteOnExit(at)


def release(*tables: DataFrame) -> None:
    """Deletes the files of tables that durable() gave. No DataFrame that reads them may be used afterwards."""
    for t in tables:
        if path := _paths.pop(t, None):
            at, files = hadoop_path(t.sparkSession, path)
            files.delete(at, True)
            files.cancelDeleteOnExit(at)


#: Bytes of a batch that a task sends to its Python worker, and Spark's own bound.
BATCH_BYTES, SPARKS_BYTES, BATCH_KEY = 4 << 20, f"{64 << 20}b", "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow() by small batches: a batch of texts stands in the executor's memory outside the heap, with room to grow, and again in the worker's.

    The bound is a setting of the session, which Spark reads when the result is computed, so it stays; another one that the user has set is kept.
    """
    spark = df.sparkSession
    if spark.conf.get(BATCH_KEY) == SPARKS_BYTES:
        spark.conf.set(BATCH_KEY, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


def sliced(batches, rows: int = 512, size: int = 16 << 20):
    """Arrow batches in parts of few rows and bytes (but one row at least), so a Python worker holds few texts at once; its unused memory is given back."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        wide = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type)]
        upto = np.cumsum(sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in wide), np.zeros(batch.num_rows, np.int64)))
        at = 0
        while at < batch.num_rows:
            most = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "right"))
            end = min(at + rows, max(most, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
        del batch, wide
        pa.default_memory_pool().release_unused()


def fold(key: str, mod: int) -> Column:
    """crc32 of the key as text, modulo mod; a null key counts as empty text (crc 0)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % mod


def by_word_count(text: str) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def numbers(rows: list[tuple[int, int]]):
    """Pairs as an Arrow table: Spark takes it as it is, a list would be read by Python workers of their own on the executors, beside those of mapInArrow()."""
    import pyarrow as pa

    return pa.table({"doc_id": pa.array([a for a, _ in rows], pa.int64()), "label": pa.array([b for _, b in rows], pa.int32())})


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, max_chars: int) -> list[tuple[str, int]]:
    """At most per_class texts of each class (0 and 1), of max_chars characters in sum, drawn by a seeded hash of doc_id, in a stable order.

    Only label rows that satisfy `learn` (a condition on doc_id) are seen; rows with null label or doc_id are not
    drawn, nor are documents with null text. Of documents with one doc_id one text is taken, and a doc_id that is
    labelled with both classes counts for both. Whole texts are taken, long ones too, until max_chars is used up;
    one that would pass it is left out, and shorter ones after it may still come. So the driver gets at most
    2 * max_chars characters, whatever the tables hold.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(learn & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).distinct()
    picked = None
    for k in (0, 1):
        part = known.where(F.col("label") == k).withColumn("_h", F.xxhash64("doc_id", F.lit(17))).orderBy("_h", "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    # at most 2 * per_class rows of three numbers: a proven bound for the broadcast
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("_h", "doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = durable(rows.withColumn("n", F.length("text")))
    taken, used = [], [0, 0]
    for r in sorted(rows.select("_h", "doc_id", "label", "n").collect()):  # at most 2 * per_class rows of four numbers
        if used[r["label"]] + r["n"] <= max_chars:
            used[r["label"]] += r["n"]
            taken.append((r["doc_id"], r["label"]))
    wanted = docs.sparkSession.createDataFrame(numbers(taken), "doc_id long, label int") if taken else None
    found = rows.join(F.broadcast(wanted), ["doc_id", "label"]).select("_h", "doc_id", "label", "text").collect() if taken else []
    release(rows)
    return [(r["text"], r["label"]) for r in sorted(found, key=lambda r: (r["_h"], r["doc_id"], r["label"]))]
