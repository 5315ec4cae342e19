"""Hard negatives by a two-dimensional block matrix multiply.

Rows are cut into blocks of about `row_block` vectors, anchors into blocks of about `anchor_block`, both by a bucket of their label
and a hash, and each block's matrix into chunks of dimensions. A block of rows and a block of anchors meet, chunk by chunk, in a
join on chunk and a cell of the grid of blocks (rows are copied along one side of the grid, anchors along the other), and
give a partial tile of scores, which is shuffled by its place and added as int64. A whole tile is reduced to the first few of each
anchor, and these to the first few of all. This is done twice: for tiles in which a row has an anchor's label (they give
the positives), then for tiles in which one hasn't (they give the negatives in each positive's window). Partial tiles
travel in the narrowest integer type that holds them. So many anchors take part in a round that its partial tiles are
at most `round_bytes`, or ROUND_X times the vectors, whichever is more; each round's result is written, and its shuffle files go.

A component x becomes floor(scale * x); products are sums of longs (those beyond a long wrap, as components beyond one are cut to
one). Rows with a null id, a null label, a null vector or a null or non-finite component take no part. Vectors may differ in length: what
one lacks counts as 0. Rows alike in id, label and vector count once; an anchor's own id is never its positive or
negative. Equal scores go by the smaller id. Fewer rows than asked for give what there is; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import durable, release

LABEL_BUCKETS, ROUND_X, GRID, MOST_CHUNKS = 64, 2, 8, 16
EXACT = 1 << 53


def narrow(a: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them."""
    low, high = (int(a.min()), int(a.max())) if a.size else (0, 0)
    return a.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def packed(a: np.ndarray) -> bytes:
    a = narrow(a)
    return bytes([a.itemsize]) + a.tobytes()


def unpacked(b: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(b, f"<i{b[0]}", offset=1).reshape(-1, columns)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers as int64: by floating-point numbers where all sums are exact in them."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    top = [max(-int(m.min()), int(m.max()), 1) for m in (a, b)]
    if top[0] * top[1] * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def usable(df: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """id, label, q (components as longs) of the rows that take part, once each."""
    whole = F.transform(F.col(vector), lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(9.2e18)), F.lit(-9.2e18))).cast("long"))
    fine = F.forall(F.col(vector), lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    rows = df.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(fine)
    return rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("q")).distinct()


def blocked(rows: DataFrame, per_block: int) -> tuple[DataFrame, int, int]:
    """rows with a block number, how many blocks there are, and how many rows."""
    bucket = F.pmod(F.xxhash64("label"), F.lit(LABEL_BUCKETS)).cast("int")
    counts = sorted((r["b"], r["count"]) for r in rows.groupBy(bucket.alias("b")).count().collect())  # at most LABEL_BUCKETS rows
    base, starts = 0, []
    for b, n in counts:
        many = -(-n // per_block)
        starts.append((b, base, many))
        base += many
    if not starts:
        return rows.withColumn("block", F.lit(0)), 0, 0
    start = rows.sparkSession.createDataFrame(starts, "_b int, _base int, _many int")
    place = F.col("_base") + F.pmod(F.xxhash64("id", "label", "q"), F.col("_many"))
    return rows.withColumn("_b", bucket).join(F.broadcast(start), "_b").withColumn("block", place.cast("int")).drop("_b", "_base", "_many"), base, sum(n for _, n in counts)


PANEL = "block int, chunk int, ids binary, labels binary, more binary, part binary"


def panels(rows: DataFrame, width: int, chunks: int) -> DataFrame:
    """One row a block and chunk of dimensions: its rows by id, with ids and labels; `more` is empty."""

    def pack(group: pa.Table) -> pa.Table:
        ids, labels = (group.column(k).to_numpy().astype(np.int64) for k in ("id", "label"))
        vectors = group.column("q").combine_chunks()
        lengths = np.diff(vectors.offsets.to_numpy())
        matrix = np.zeros((len(ids), width * chunks), np.int64)
        row, flat = np.repeat(np.arange(len(ids)), lengths), vectors.flatten().to_numpy().astype(np.int64)
        matrix[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        order = np.lexsort((labels, ids))
        block = group.column("block")[0].as_py()
        out = [(block, k, ids[order].tobytes(), labels[order].tobytes(), b"", packed(matrix[order, k * width : (k + 1) * width])) for k in range(chunks)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    fields = pa.schema([("block", pa.int32()), ("chunk", pa.int32()), *((k, pa.binary()) for k in ("ids", "labels", "more", "part"))])
    return rows.select("block", "id", "label", "q").groupBy("block").applyInArrow(pack, PANEL)


def with_windows(anchors: DataFrame, near: DataFrame, positives: int, low: int, high: int) -> DataFrame:
    """anchors with `more` in chunk 0: id, score, least and greatest score of the window for each anchor's places; one without a positive has an empty window."""

    def fill(panel: pa.Table, found: pa.Table) -> pa.Table:
        if not panel.num_rows:
            return panel
        out = np.tile(np.array([0, 0, 1, 0], np.int64), (len(panel.column("ids")[0].as_py()) // 8, positives, 1))
        for r in found.to_pylist():
            s = r["score"]
            out[r["a"], r["rank"] - 1] = r["id"], s, -(-low * s // 100), high * s // 100
        at = panel.schema.get_field_index("more")
        return panel.set_column(at, "more", pa.array([out.tobytes()], pa.binary()))

    first, rest = anchors.where("chunk = 0"), anchors.where("chunk > 0")
    return first.groupBy("block").cogroup(near.select("j", "a", "rank", "id", "score").groupBy("j")).applyInArrow(fill, PANEL).unionByName(rest)


def tiles(rows: DataFrame, anchors: DataFrame, width: int, blocks: tuple[int, int], alike: bool) -> DataFrame:
    """Partial tiles i, j, k, tile and, with chunk 0, what names their rows and anchors; only where a row and an anchor have one label (alike), or not."""
    side = [max(1, -(-b // GRID)) for b in blocks]
    a = rows.select("chunk", F.col("block").alias("i"), F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("part").alias("a"), F.pmod(F.xxhash64("block"), F.lit(side[0])).alias("_r"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(side[1] - 1).cast("long"))).alias("_c"))
    b = anchors.select("chunk", F.col("block").alias("j"), F.col("ids").alias("b_ids"), F.col("labels").alias("b_labels"), F.col("more"), F.col("part").alias("b"), F.pmod(F.xxhash64("block"), F.lit(side[1])).alias("_c"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(side[0] - 1).cast("long"))).alias("_r"))
    both = a.hint("merge").join(b.hint("merge"), ["chunk", "_r", "_c"]).select("i", "j", "chunk", "a_ids", "a_labels", "a", "b_ids", "b_labels", "more", "b")

    def multiply(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                i, j, k, a_ids, a_labels, a, b_ids, b_labels, more, b = (c[r].as_py() for c in batch.columns)
                la, lb = np.frombuffer(a_labels, np.int64), np.frombuffer(b_labels, np.int64)
                shared = np.intersect1d(la, lb).size
                if not (shared if alike else not shared or len(np.union1d(la, lb)) > 1):
                    continue
                names = (a_ids, a_labels, b_ids, b_labels, more) if k == 0 else (None,) * 5
                row = (i, j, k, packed(product(unpacked(a, width), unpacked(b, width))), *names)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, fields, strict=True)], schema=fields)

    fields = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("k", pa.int32()), *((n, pa.binary()) for n in ("tile", "a_ids", "a_labels", "b_ids", "b_labels", "more"))])
    return both.mapInArrow(multiply, "i int, j int, k int, tile binary, a_ids binary, a_labels binary, b_ids binary, b_labels binary, more binary")


def first_of(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, groups: np.ndarray, k: int) -> np.ndarray:
    """Which of the entries (score, row, group) are among the first k of their group."""
    order = np.lexsort((ids[rows], -scores, groups))
    g = groups[order]
    start = np.maximum.accumulate(np.where(np.r_[True, g[1:] != g[:-1]], np.arange(len(g)), 0)) if len(g) else np.zeros(0, np.int64)
    return order[np.arange(len(g)) - start < k]


FOUND = "j int, a int, p int, anchor_id long, positive_id long, positive_score long, id long, score long"


def reduced(parts: DataFrame, alike: bool, k: int, positives: int) -> DataFrame:
    """Adds partial tiles; the first k of each anchor with its label (alike), or of each anchor and positive in its window with other labels.

    `more` of the anchors holds, for each of `positives` places, id, score, and the window's least and greatest score.
    """

    def add(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        head = next(r for r in rows if r["k"] == 0)
        ids, labels, anchors, wanted = (np.frombuffer(head[n], np.int64) for n in ("a_ids", "a_labels", "b_ids", "b_labels"))
        total = np.zeros((len(ids), len(anchors)), np.int64)
        for r in rows:
            total += unpacked(r["tile"], len(anchors))
        same = labels[:, None] == wanted[None, :]
        fields = pa.schema([("j", pa.int32()), ("a", pa.int32()), ("p", pa.int32()), *((n, pa.int64()) for n in ("anchor_id", "positive_id", "positive_score", "id", "score"))])
        out = []
        if alike:
            at, to = np.nonzero(same & (ids[:, None] != anchors[None, :]))
            kept = first_of(total[at, to], ids, at, to, k)
            at, to = at[kept], to[kept]
            none = np.full(len(at), 0)
            out.append((to, none, anchors[to], none, none, ids[at], total[at, to]))
        else:
            windows = np.frombuffer(head["more"], np.int64).reshape(len(anchors), positives, 4)
            other = ~same & (ids[:, None] != anchors[None, :])
            for p in range(positives):
                low, high = windows[:, p, 2], windows[:, p, 3]
                at, to = np.nonzero(other & (total >= low) & (total <= high))
                kept = first_of(total[at, to], ids, at, to, k)
                at, to = at[kept], to[kept]
                out.append((to, np.full(len(at), p), anchors[to], windows[to, p, 0], windows[to, p, 1], ids[at], total[at, to]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        j = np.full(len(columns[0]), head["j"])
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip([j, *columns], fields, strict=True)], schema=fields)

    return parts.groupBy("i", "j").applyInArrow(add, FOUND)


def first_rows(found: DataFrame, group: list[str], k: int) -> DataFrame:
    """The first k of each group with their rank; Spark keeps k of each group in a task before it shuffles."""
    by = Window.partitionBy(*group).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def mine(df: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, row_block: int = 1024, anchor_block: int = 256, chunk: int = 32, round_bytes: int = 96 << 20) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first `positives` rows
    of one label, the first `negatives` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.

    is_anchor: a condition on the column `id`. low and high: whole percents.
    """
    rows = durable(usable(df, key, vector, label, scale))
    stats = rows.agg(F.max(F.size("q")).alias("d"), F.sum(F.size("q")).alias("cells")).first()
    empty = df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if stats["d"] is None:
        return empty
    width = max(1, min(chunk, stats["d"]), -(-stats["d"] // MOST_CHUNKS))
    chunks = max(1, -(-stats["d"] // width))
    placed, n_i, n_rows = blocked(rows, row_block)
    chosen, n_j, n_anchors = blocked(rows.where(is_anchor), anchor_block)
    chosen = durable(chosen)
    if not n_anchors:
        return empty
    a = durable(panels(placed, width, chunks))
    b = durable(panels(chosen, width, chunks))

    most = max(round_bytes, ROUND_X * 8 * stats["cells"])

    def rounds(anchors: DataFrame, alike: bool, k: int, cells: int) -> DataFrame:
        """reduced() for all blocks of anchors, so many in a round that `cells` scores of all of them make few enough bytes."""
        many = min(n_j, max(1, -(-cells * chunks * 4 // most)))
        group, out = ["j", "a"] if alike else ["j", "a", "p"], None
        for r in range(many):
            here = anchors.where(F.col("block") % many == r) if many > 1 else anchors
            part = durable(first_rows(reduced(tiles(a, here, width, (n_i, -(-n_j // many)), alike), alike, k, positives), group, k))
            out = part if out is None else out.unionByName(part)
        return out

    share = rows.groupBy(F.pmod(F.xxhash64("label"), F.lit(LABEL_BUCKETS)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_anchor).alias("m")).agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    near = rounds(b, True, positives, share)
    windowed = durable(with_windows(b, near, positives, low, high))
    found = rounds(windowed, False, negatives, n_rows * n_anchors)
    release(rows, chosen, windowed, a, b)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
