"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

A document's size is its number of words. Sources share the sum of all sizes by weight; a source that
would exceed `epochs` times its own size is clamped there and the excess is shared by the others by
weight, until none is above. A source whose target is r times its size takes each document floor(r) times,
and once more the documents that come first in a seeded order, until what is left of the target is used up.

The order is by a hash of doc_id and text. The place where it is cut is found from sums over hash buckets,
so no source is sorted or gathered as a whole; only the one bucket with the cut is.

Null text has size 0 and is taken 0 times in words. A null source is a source of its own, last in order.
Repeated rows (equal doc_id and text) come one after another in the order and are counted one by one, but
share one fate at the cut. Empty tables give an empty result. Extra columns are kept by mixed() alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import by_word_count, durable

#: The order is a number of 60 bits; its first 12 name the bucket.
ORDER_HEX, BUCKET_SHIFT = 15, 48


def weight_of(place: Column, weights: list[float]) -> Column:
    """The weight of the source at a place (from 0) in the order of sources; weights repeat."""
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))


def water_fill(sources: DataFrame, weights: list[float], epochs: float) -> DataFrame:
    """source, source_size, target of each source of sources (source, source_size), one row a source.

    With sources in the order of epochs * size / weight, those before the first that can take its share of
    what the ones before it leave are clamped. One task sorts this table: a row a source, whatever the rows.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    w = sources.withColumn("_w", weight_of(F.row_number().over(named) - 1, weights)).withColumn("_cap", F.col("source_size") * float(epochs))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = w.withColumn("_left", F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    w = w.withColumn("_rate", F.col("_left") / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    # the rates fall from that source on, so its rate is the greatest of those that fit, ties or not
    w = w.withColumn("_rate", F.max(F.when(F.col("_cap") / F.col("_w") >= F.col("_rate"), F.col("_rate"))).over(every))
    return w.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_w") * F.col("_rate"), F.col("_cap"))).alias("target"))


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """docs with _size (words) and _o (the place in the seeded order)."""
    seeded = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}:"), F.coalesce("text", F.lit(""))).cast("binary"))
    return docs.withColumn("_size", by_word_count("text")).withColumn("_o", F.conv(F.substring(seeded, 1, ORDER_HEX), 16, 10).cast("long"))


def with_repeats(rows: DataFrame, slim: DataFrame, weights: list[float], epochs: float) -> DataFrame:
    """rows (source, _size, _o, ..) with _source_size, _target and _times (how often the mix takes the row).

    slim: source, _size, _o of the same rows, a table of its own, so texts are not read again for the sums.
    """
    slim = slim.withColumn("_b", F.shiftright("_o", BUCKET_SHIFT))
    sums = durable(slim.groupBy("source", "_b").agg(F.sum("_size").alias("_s")))
    plan = water_fill(sums.groupBy("source").agg(F.sum("_s").alias("source_size")), weights, epochs)
    plan = plan.withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = plan.withColumn("_whole", F.floor("_rate").cast("int"))
    plan = durable(plan.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size")))
    # the bucket in which the running sum passes the rest
    running = Window.partitionBy("source").orderBy("_b")
    sums = sums.withColumn("_to", F.sum("_s").over(running))
    p = plan.select(F.col("source").alias("_src"), "_rest")
    cut = sums.join(p, F.col("source").eqNullSafe(F.col("_src"))).where((F.col("_rest") > 0) & (F.col("_to") > F.col("_rest")))
    cut = durable(cut.groupBy("_src", "_rest").agg(F.min(F.struct("_b", (F.col("_to") - F.col("_s")).alias("_from"))).alias("_c")).select("_src", "_rest", "_c._b", "_c._from"))
    # rows of that bucket alone, equal rows first summed: the rows before and at the cut
    inside = slim.select(F.col("source"), F.col("_b").alias("_rb"), "_o", "_size").join(cut, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_rb") == F.col("_b")))
    inside = inside.groupBy("_src", "_o", "_from", "_rest").agg(F.sum("_size").alias("_s"))
    inside = inside.withColumn("_to", F.col("_from") + F.sum("_s").over(Window.partitionBy("_src").orderBy("_o")))
    # the row that the cut falls into is taken if more than half of it fits
    last = inside.where(F.col("_to") - F.col("_s") / 2 <= F.col("_rest")).groupBy("_src").agg(F.max("_o").alias("_last"))
    first = cut.select(F.col("_src").alias("_s2"), F.col("_b").alias("_cb"))
    plan = plan.join(first, F.col("source").eqNullSafe(F.col("_s2")), "left").join(last, F.col("source").eqNullSafe(F.col("_src")), "left")
    plan = plan.select(F.col("source").alias("_src"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "_whole", "_rest", "_cb", "_last")
    plan = durable(plan)  # a row a source, of known size: broadcast if that is small, else joined by sorting
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("_src")))
    o, at = F.col("_o"), F.shiftright("_o", BUCKET_SHIFT)
    more = F.when(F.col("_rest") <= 0, 0).when(F.col("_cb").isNull(), 1).when(at < F.col("_cb"), 1).when((at == F.col("_cb")) & (o <= F.coalesce("_last", F.lit(-1))), 1).otherwise(0)
    more = F.least(more, F.greatest(F.lit(0), F.lit(int(epochs)) - F.col("_whole")))
    return out.withColumn("_times", F.col("_whole") + more).drop("_o", "_src", "_whole", "_rest", "_cb", "_last")


def mix_plan(docs: DataFrame, weights: list[float], epochs: float = 3, seed: int = 13) -> DataFrame:
    """doc_id, size, source_size, target, taken (words) for each row of docs (doc_id, text, source)."""
    slim = durable(sized(docs, seed).select("doc_id", "source", "_size", "_o"))
    rows = with_repeats(slim, slim, weights, epochs)
    return rows.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_times")).alias("taken"))


def mixed(docs: DataFrame, weights: list[float], epochs: float = 3, seed: int = 13) -> DataFrame:
    """The mix: the rows of docs, all columns, each as often as it is taken."""
    rows = sized(docs.select("doc_id", "text", "source", F.struct("*").alias("row")), seed)
    rows = with_repeats(rows, durable(rows.select("source", "_size", "_o")), weights, epochs).where(F.col("_times") > 0)
    return rows.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("row.*")
