"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

Documents are cut into pieces of at most `size` tokens. Full pieces are sequences of their own. The others
are dealt at random (seeded) into shards of about `shard_rows` pieces; each shard starts from best fit
decreasing, then tries to empty its least filled bins: a piece moves to the fullest other bin that takes
it, or is exchanged one for one or one for two (or two for one) such that the other bin gets fuller. Each
step increases the sum of squared fills. The search of a shard ends when it finds no step, or after TRIALS steps; it tries pairs
among the PAIR_ITEMS first pieces of a bin, and one for two with the OPEN_BINS bins of most room, so it may miss a step.

Null or empty text is a document of the single separator token. Repeated rows are packed as often as they
occur; rows with equal or null doc_id stay apart because shards are dealt without looking at keys.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import durable, mapped, sliced
from quarry.llm.token_counts import encoder

#: A shard takes time, not space: shards are dealt to as many tasks, not by their bytes.
SHARD_ROWS, MOST_TASKS = 4096, 20_000
#: Bounds of the search in a shard.
TRIALS, PAIR_ITEMS, OPEN_BINS = 4000, 12, 64


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers: best fit decreasing."""
    bins: list[list[int]] = []
    slack: list[tuple[int, int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = bisect_left(slack, (lengths[i], -1))
        if at == len(slack):
            bins.append([i])
            left = (size - lengths[i], len(bins) - 1)
        else:
            free, b = slack.pop(at)
            bins[b].append(i)
            left = (free - lengths[i], b)
        if left[0]:
            insort(slack, left)
    return bins


def improved(lengths: list[int], bins: list[list[int]], size: int, trials: int = TRIALS) -> list[list[int]]:
    """Local search: empties underfull bins while steps that increase the squared fill are found."""
    item = np.asarray(lengths, np.int64)
    fill = np.array([sum(lengths[i] for i in b) for b in bins], np.int64)
    where = np.empty(len(item), np.int64)
    for b, items in enumerate(bins):
        where[items] = b
    bins = [set(b) for b in bins]
    given_up: set[int] = set()

    def move(i: int, b: int) -> None:
        a = where[i]
        bins[a].discard(i)
        bins[b].add(i)
        fill[a] -= item[i]
        fill[b] += item[i]
        where[i] = b

    def step(e: int) -> bool:
        free = np.where((fill > 0) & (np.arange(len(fill)) != e), size - fill, -1)
        mine = sorted(bins[e], key=lambda i: (-item[i], i))
        for i in mine:  # move to the bin that it fills best, if that one gets fuller than this one is
            fits = np.where(fill + item[i] > fill[e], free - item[i], -1)
            if (fits >= 0).any():
                move(i, int(np.argmin(np.where(fits >= 0, fits, size + 1))))
                return True
        open_item = (free[where] > 0) & (fill[where] >= fill[e])
        for i in mine:  # one for one
            gain = np.where(open_item & (item < item[i]) & (item[i] - item <= free[where]), item[i] - item, 0)
            j = int(gain.argmax())
            if gain[j] > 0:
                b = int(where[j])
                move(i, b)
                move(j, e)
                return True
        for x in range(min(len(mine), PAIR_ITEMS)):  # two of this bin for one of another
            for y in range(x + 1, min(len(mine), PAIR_ITEMS)):
                two = item[mine[x]] + item[mine[y]]
                gain = np.where(open_item & (item < two) & (two - item <= free[where]), two - item, 0)
                j = int(gain.argmax())
                if gain[j] > 0:
                    b = int(where[j])
                    move(mine[x], b)
                    move(mine[y], b)
                    move(j, e)
                    return True
        for b in np.argsort(-free)[:OPEN_BINS].tolist():  # one of this bin for two of another
            if free[b] <= 0 or fill[b] < fill[e]:
                continue
            other = sorted(bins[b], key=lambda i: (item[i], i))[:PAIR_ITEMS]
            for i in mine:
                for x in range(len(other)):
                    for y in range(x + 1, len(other)):
                        gain = item[i] - item[other[x]] - item[other[y]]
                        if 0 < gain <= free[b]:
                            move(i, b)
                            move(other[x], e)
                            move(other[y], e)
                            return True
        return False

    while trials > 0:
        under = [b for b in np.flatnonzero((fill > 0) & (fill < size)).tolist() if b not in given_up]
        if not under or fill[fill > 0].sum() > size * (np.count_nonzero(fill) - 1):
            break  # no bin can be saved any more
        e = min(under, key=lambda b: (fill[b], b))
        stepped = False
        while bins[e] and trials > 0:
            trials -= 1
            if not step(e):
                break
            stepped = True
        if stepped:  # other bins have changed and may be emptied now
            given_up.clear()
        given_up.add(e)
    return [sorted(b, key=lambda i: (-lengths[i], i)) for b in bins if b]


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each document."""

    def run(batches):
        enc, end, width = encoder(tokenizer), int(end_id).to_bytes(4, "little"), 4 * size
        for batch in sliced(batches):
            of, number, crc, length = [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = enc.packed(text or "") + end
                for k in range(0, len(ids), width):
                    part = ids[k : k + width]
                    of.append(row)
                    number.append(k // width)
                    crc.append(zlib.crc32(part))
                    length.append(len(part) // 4)
            n = np.array(number, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(n.astype(np.int32)), pa.array(n * size), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, shard_rows: int = SHARD_ROWS, seed: int = 7) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs (doc_id, text)."""
    cut = durable(pieces(docs, tokenizer, size, end_id).withColumn("_u", F.rand(seed)))
    open_rows = cut.where(F.col("length") < size).count()
    shards = max(1, round(open_rows / shard_rows))

    def place(batch: pa.Table) -> pa.Table:
        lengths = batch.column("length").to_pylist()
        shard = batch.column("_shard")[0].as_py()
        rows, seq, offset = [], [], []
        for k, items in enumerate(improved(lengths, best_fit(lengths, size), size)):
            at = 0
            for i in items:
                rows.append(i)
                seq.append(2 * ((shard << 31) + k))
                offset.append(at)
                at += lengths[i]
        out = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"]).take(pa.array(rows, pa.int64()))
        return out.append_column("sequence_id", pa.array(seq, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = cut.where(F.col("length") < size).withColumn("_shard", F.floor(F.col("_u") * shards).cast("long")).repartition(min(shards, MOST_TASKS), "_shard").groupBy("_shard").applyInArrow(place, schema)
    full = cut.where(F.col("length") == size).drop("_u").withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full)
