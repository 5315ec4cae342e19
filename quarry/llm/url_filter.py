"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact join of the possible hits.

Rules of hosts and path prefixes decide first; the longest that fits wins. What no rule decides is blocked
if its canonical form is listed, else allowed. The filter is a table of blocks of four 64-bit lanes, one
bit of each lane set by a URL, as many blocks as the list needs but at most MAX_BLOCKS, so what is broadcast
has a proven bound (40 bytes a block, 10.5 MB in all); a longer list only makes more possible hits. The exact
join removes those: of the possible hits' distinct keys, those that are listed are joined back to the pages.

A null url, or one without `://`, has empty host and path, fits no rule and is never listed. Host case
counts only beyond A-Z. Every row of pages is judged, repeated rows too; rule strings must differ;
empty pages give an empty result and an empty list blocks nothing. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import durable, release

MAX_BLOCKS, PER_BLOCK = 1 << 18, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """host without www. or m., and path without a closing / or .html; scheme, query and fragment don't count."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(/|\.html)$", ""))


def rule_for(rules: list[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule (host followed by path) and its verdict, null if none fits. rules: verdict, host, path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def lanes(key: str) -> list[Column]:
    """Four masks of one bit each, by six bits of a hash for each."""
    return [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({key}, 2), {6 * k}) & 63 as int))") for k in range(4)]


def block_of(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks))


def bloom(listed: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The filter's blocks (block, b0..b3) of the distinct keys, and how many blocks there may be."""
    count = listed.count()
    blocks = 64
    while blocks * PER_BLOCK < count and blocks < MAX_BLOCKS:
        blocks *= 2
    bits = listed.select(block_of(key, blocks).alias("block"), *[m.alias(f"b{k}") for k, m in enumerate(lanes(key))])
    return bits.groupBy("block").agg(*[F.bit_or(f"b{k}").alias(f"b{k}") for k in range(4)]), blocks


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for each row of pages (page_id, url).

    listed: one column of canonical URLs (see canonical()), nulls and repeats allowed.
    """
    url = F.col("url")
    page = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    name, verdict = rule_for(rules, F.col("host"), F.col("path"))
    page = page.withColumn("rule", name).withColumn("_said", verdict).withColumn("_key", F.when(F.col("host") != "", canonical(F.col("host"), F.col("path"))))
    keys = durable(listed.toDF("_key").where(F.col("_key").isNotNull()).distinct())
    table, blocks = bloom(keys, "_key")
    probe = page.withColumn("block", block_of("_key", blocks))
    probe = probe.join(F.broadcast(durable(table)), "block", "left")  # at most MAX_BLOCKS rows
    hit = reduce(lambda a, b: a & b, [F.col(f"b{k}").bitwiseAND(m) == m for k, m in enumerate(lanes("_key"))])
    maybe = F.col("_key").isNotNull() & F.col("_said").isNull() & F.coalesce(hit, F.lit(False))
    probe = probe.select("page_id", "host", "path", "rule", F.coalesce("_said", F.lit("allow")).alias("verdict"), F.when(maybe, F.col("_key")).alias("_key"))
    # possible hits alone are joined, by few columns: one row a key tells which are listed, and Spark can split the join of a hot URL
    hits = durable(probe.where("_key is not null"))
    found = durable(hits.select("_key").distinct().join(keys, "_key", "left_semi"))
    release(keys)
    judged = hits.join(found.withColumn("listed", F.lit(True)), "_key", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    judged = judged.withColumn("verdict", F.when(F.col("listed"), "block").otherwise(F.col("verdict")))
    out = ["page_id", "host", "path", "rule", "verdict", "listed"]
    return probe.where("_key is null").withColumn("listed", F.lit(False)).select(*out).unionByName(judged.select(*out))
