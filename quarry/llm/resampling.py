"""Target-distribution importance resampling: documents are drawn as if from the distribution of a target table.

A feature is a run of 1 to `longest` words (see words.py), joined by a space, and is counted in one of `buckets` buckets by its
CRC. A bucket's gain is floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))), s of S features in all
documents and t of T in the target; a document's weight is the sum of the gains of its features, its score the
weight plus seeded Gumbel noise of its doc_id. Of the documents with at least `least_words` words, `percent` % with the highest
scores are drawn (rounded down), ties to the smaller doc_id.

Counts leave a task as one row a bucket, so they are summed before they are shuffled; counts and gains, a number a bucket, are
all that the driver holds. The least drawn key (score, then doc_id, then the number of features) is found exactly by
digits: a pass counts a digit of the keys that agree with the digits so far, at most 2 ** DIGIT rows to the driver, and goes
on with the digit in which the wanted place falls. Only what is drawn is sorted by range; a row's rank is its place in its
range after the rows of the ranges before. Rows that are alike in all that is returned are one row with a count until they
are ranked, so no key is too frequent.

Null text has no words and null target texts count for nothing. A null doc_id has noise as if it were empty text and
comes first among ties. Repeated rows are rows of their own, with ranks of their own. Empty documents give an empty
result; an empty target counts as T = 0. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import durable, sliced
from quarry.llm.words import chunks

DIGIT, SIGN = 14, 1 << 63
KEY = ["score", "doc_id", "n_features"]


class Buckets(dict):
    """The bucket of each feature; what is known is forgotten when there are MOST of them."""

    MOST = 1 << 18

    def __init__(self, count: int):
        super().__init__()
        self.count = count

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[feature] = k = zlib.crc32(feature) % self.count
        return k


def places(text: bytes | None, longest: int, known: Buckets) -> tuple[int, np.ndarray]:
    """How many words a text has, and the buckets of its features."""
    if not text:
        return 0, np.zeros(0, np.int64)
    n, tail, out = 0, [], []
    for part in chunks(text):
        n += len(part)
        out.append(np.fromiter(map(known.__getitem__, part), np.int64, len(part)))
        if longest > 1:
            both = tail + part
            for k in range(2, longest + 1):  # runs that end in this part
                runs = [b" ".join(both[i - k + 1 : i + 1]) for i in range(max(len(tail), k - 1), len(both))]
                out.append(np.fromiter(map(known.__getitem__, runs), np.int64, len(runs)))
            tail = both[-(longest - 1) :]
    return n, np.concatenate(out)


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Features in each bucket, of all rows of texts (text)."""

    def run(batches):
        total, known = np.zeros(buckets, np.int64), Buckets(buckets)
        for batch in sliced(batches):
            for text in batch.column(0):
                total += np.bincount(places(text.as_py(), longest, known)[1], minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("binary").alias("text")).where("text is not null").mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(docs: DataFrame, target: DataFrame, longest: int, buckets: int) -> np.ndarray:
    s, t = (bucket_counts(x, longest, buckets).tolist() for x in (docs, target))
    all_s, all_t = sum(s), sum(t)
    return np.array([math.floor(1000 * math.log(float((b + 1) * (all_s + buckets)) / float((a + 1) * (all_t + buckets)))) for a, b in zip(s, t, strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int = 1, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score for each row of docs (doc_id, text)."""
    buckets = len(gain)

    def run(batches):
        known = Buckets(buckets)
        for batch in sliced(batches):
            ids, out = batch.column(0).to_pylist(), []
            for doc_id, text in zip(ids, batch.column(1), strict=True):
                n, at = places(text.as_py(), longest, known)
                weight = int(gain[at].sum())
                out.append((n, len(at), weight, weight + noise(doc_id, seed)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in out], pa.int64()) for k in range(4))], ["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def last_drawn(rows: DataFrame, keys: list[Column], wanted: int) -> list[int]:
    """The first values of the key of the row in place `wanted` (from 1) of rows sorted by keys (longs without null, highest bit first).

    Fewer values than keys mean that all rows which agree with them are drawn, or that place ends exactly there.
    """
    values: list[int] = []
    for key in keys:
        here = rows
        for k, v in zip(keys, values, strict=False):
            here = here.where(k == v)
        low, high, n = here.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
        if n == wanted and values:
            return values
        bits = (low ^ high).bit_length() if (low < 0) == (high < 0) else 64
        high_bits = (low >> bits) << bits if bits < 64 else 0  # bits that all share
        prefix, done = 0, 0  # digits found, as a number of `done` bits
        while done < bits:
            width = min(DIGIT, bits - done)
            shift = bits - done - width
            place = key.bitwiseXOR(F.lit(-SIGN)) if bits == 64 else key.bitwiseAND(F.lit((1 << bits) - 1))  # signs turned, so unsigned order is the keys' own
            unsigned = lambda by: F.shiftrightunsigned(place, by)  # noqa: E731, B023
            digit = unsigned(shift).bitwiseAND(F.lit((1 << width) - 1))
            same = here if not done else here.where(unsigned(shift + width) == F.lit(prefix))
            for r in sorted(same.groupBy(digit.alias("d")).count().collect()):  # at most 2 ** DIGIT rows
                if wanted <= r["count"]:
                    prefix = (prefix << width) | r["d"]
                    break
                wanted -= r["count"]
            done += width
        values.append(prefix - SIGN if bits == 64 else high_bits | prefix)
    return values


def ranked(rows: DataFrame, order: list[Column], parts: int) -> DataFrame:
    """rows (with a count `_c`) with `_before`: how many rows come before, in `order`."""
    dealt = durable(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sums = sorted((r["_part"], r["n"]) for r in dealt.groupBy("_part").agg(F.sum("_c").alias("n")).collect())  # a row a range
    starts, upto = [], 0
    for part, n in sums:
        starts.append((part, upto))
        upto += n
    if not starts:
        return rows.withColumn("_before", F.lit(0).cast("long"))
    start = dealt.sparkSession.createDataFrame(starts, "_part int, _start long")
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(start), "_part").withColumn("_before", F.col("_start") + F.coalesce(F.sum("_c").over(inside), F.lit(0))).drop("_part", "_start")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of docs (doc_id, text); target: (text). rank is null for rows that aren't drawn."""
    table = durable(scored(docs, gains(docs, target, longest, buckets), longest, seed))
    enough = table.where(F.col("n_words") >= least_words)
    wanted = enough.count() * percent // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not wanted:
        return table.select(*out, F.lit(None).cast("long").alias("rank"))
    # the keys upside down where the highest comes first; a null doc_id stands before all others
    keys = [F.bitwise_not("score"), F.col("doc_id").isNotNull().cast("long"), F.coalesce("doc_id", F.lit(0).cast("long")), F.col("n_features")]
    last = last_drawn(enough, keys, wanted)
    before, at = F.lit(False), F.lit(True)
    for key, value in zip(keys, last, strict=False):
        before, at = before | (at & (key < value)), at & (key == value)
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features")]
    drawn = enough.where(before | at).groupBy(*out).agg(F.count(F.lit(1)).alias("_c"))
    placed = durable(ranked(drawn, order, max(1, min(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-wanted // 1000)))))
    # rows alike take the places after _before; those beyond the wanted number stay undrawn
    many = F.greatest(F.least(F.col("_c"), F.lit(wanted) - F.col("_before")), F.lit(0))
    first = placed.where(many > 0).select(*out, F.explode(F.sequence(F.col("_before") + 1, F.col("_before") + many)).alias("rank"))
    over = placed.where(many < F.col("_c")).select(*out, F.explode(F.array_repeat(F.lit(None).cast("long"), (F.col("_c") - many).cast("int"))).alias("rank"))
    rest = table.where((F.col("n_words") < least_words) | ~(before | at)).select(*out, F.lit(None).cast("long").alias("rank"))
    return rest.unionByName(first).unionByName(over)


def drawn_documents(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of docs that resample() draws, with their rank; doc_id must name one row each."""
    drawn = resample(docs, target, **how).where("rank is not null").select("doc_id", "rank")
    return docs.join(drawn, "doc_id")

