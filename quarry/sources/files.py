"""Files as tables: a filtered recursive listing with sizes and digests, and what a set of files adds up to."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Extensions of bills, and the limits of a scan.
EXTENSIONS = ["pdf", "ofd", "jpg", "jpeg", "png", "webp", "xml"]
MOST_FILES, MOST_BYTES, MOST_TOTAL = 2000, 100 << 20, 2 << 30


def scan_files(spark: SparkSession, folder: str, extensions: list[str] | None = None, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES, most_total: int = MOST_TOTAL, excluded: str | None = None) -> DataFrame:
    """path, relative_path, name, extension, size, status of the files under a folder, in order of path; status is ok, too-large or over-limit.

    Limits are parts of the scan: a file is over the limit if so many files, or so many bytes with its own, that aren't too large come before it.
    Hidden files and folders are left out by Spark; those under `excluded` and other extensions by a filter. Contents
    aren't read.
    """
    known = extensions or EXTENSIONS
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    files = files.withColumn("name", name).withColumn("extension", F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))).where(F.col("extension").isin(*known))
    local = r"^file:/+"  # written with one slash or three
    files = files.withColumn("relative_path", F.substring_index(F.regexp_replace("path", local, "/"), re.sub(local, "/", folder).rstrip("/") + "/", -1))
    if excluded:
        files = files.where(~F.col("relative_path").startswith(excluded.rstrip("/") + "/"))
    before = Window.partitionBy("_fits").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a listing, a row a file
    files = files.withColumn("_fits", F.col("size") <= most_bytes)
    over = (F.count(F.lit(1)).over(before) >= most_files) | (F.coalesce(F.sum("size").over(before), F.lit(0)) + F.col("size") > most_total)
    return files.withColumn("status", F.when(~F.col("_fits"), "too-large").when(over, "over-limit").otherwise("ok")).select("path", "relative_path", "name", "extension", "size", "status")


def file_digests(spark: SparkSession, folder: str, pattern: str = "*", algorithm: int = 256) -> DataFrame:
    """path, size, sha (hex), base64 of the contents of the files under a folder whose names fit the pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", algorithm).alias("sha"), F.replace(F.base64("content"), F.lit("\r\n")).alias("base64"))
