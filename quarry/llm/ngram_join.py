"""N-gram Jaccard join: near-duplicate classes of documents by a prefix-tree join of their shingle sets.

A document's set holds the hashes of its distinct shingles of `words` words. Two documents link if the
Jaccard similarity of their sets reaches `percent`; classes are connected components of links.

1. Equal sets are one node (a 64-bit hash of the set, told apart by size too), whatever the number of copies.
2. The n-grams have one global order: those common in a seeded sixteenth of the nodes last, the rarer first,
   all else by hash. Nodes that link share an n-gram of their prefixes, the first n - ceil(t n) + 1 in that
   order. Prefix n-grams are dealt to buckets; those that one node alone has go.
3. Star round: each node is compared with one hub only, the one that it shares most prefix n-grams with
   among the least nodes of like size that have them (at least a twentieth of its own n-grams, and what a
   link needs). Links give first classes. A node that shares less than a twentieth with each such node has
   the least of them as its loose hub, and isn't compared with it.
4. Block round: nodes with one hub form blocks of about BLOCK nodes, those that have it as loose hub apart. A
   node is compared with a block if it shares as many prefix n-grams with the block's nodes of other classes as
   a link needs; pairs of nodes are never listed. A group in which the hub links with all is one class by
   then, and costs nothing more; nodes of like size that only share a common passage fill few blocks.
5. Comparison: a hub's or block's nodes are stored in a prefix tree of their globally ordered sets, and a
   probing set is run through it: shared prefixes are intersected once, and a subtree is left when what
   remains of the probe and of the subtree's longest set can't reach the overlap that its shortest needs.
   Trees of many nodes, and trees with many probes, are salted. A task gives a spanning forest of its links.

Shingle and set hashes have 64 bits; different shingles or sets with equal hashes would be taken as equal.
Documents without words, or null text, have empty sets, link with nothing and are classes of their own.
A null doc_id keeps its row; it never names a class unless it has no other row. Repeated rows are copies.
Empty tables give empty results. Extra columns are not read, or kept as they are by keep_one_each().
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WORD, durable, mapped, release, sliced

WORDS, PERCENT = 5, 75
SAMPLE_EVERY, COMMON_AT, MOST_COMMON = 16, 4, 1_000_000
BUCKET_ROWS, BLOCK, BLOCK_SHINGLES, GROUP_SHINGLES, BLOOM_WORDS = 200_000, 256, 1 << 20, 1 << 17, 1 << 21
LIKE_SIZE, CELL_SIZE, TURNS, PART, BASE = 1.15, 1.03, 3, 1 << 18, 0xD1342543DE82EF95
SPACE_BYTES = [b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"]
IS_SPACE = np.isin(np.arange(256), [c[0] for c in SPACE_BYTES])


def mixed_bits(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@functools.cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2 ** 64, and of its inverse."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        table = np.full(PART + 1, base, np.uint64)
        table[0] = 1
        out.append(np.multiply.accumulate(table))
    return tuple(out)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word between ASCII white space and where it starts, from running sums over parts that end between words."""
    out, starts, at = [], [], 0
    while at < len(raw):
        to = min(len(raw), at + PART)
        if to < len(raw) and (gap := max(raw.rfind(c, at, to) for c in SPACE_BYTES)) >= at:
            to = gap + 1
        elif to < len(raw):  # one word of more than a part
            to = min((k for c in SPACE_BYTES if (k := raw.find(c, to)) >= 0), default=len(raw))
            out.append(np.array([xxhash.xxh64_intdigest(raw[at:to])], np.uint64))
            starts.append(np.array([at]))
            at = to
            continue
        b = np.frombuffer(raw, np.uint8, to - at, at)
        edge = np.flatnonzero(np.diff(IS_SPACE[b], prepend=True, append=True))
        start, end = edge[::2], edge[1::2]
        power, inverse = powers()
        run = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(power[: len(b)] * (b.astype(np.uint64) + np.uint64(1)), out=run[1:])
        out.append(mixed_bits((run[end] - run[start]) * inverse[start] + (end - start).astype(np.uint64)))
        starts.append(start + at)
        at = to
    return (np.concatenate(out), np.concatenate(starts)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def runs(w: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words."""
    h = np.full(max(0, len(w) - size + 1), size, np.uint64)
    for k in range(size):
        h = h * np.uint64(0xD6E8FEB86659FD93) + w[k : k + len(h)]
    return mixed_bits(h).view(np.int64)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Of each text the hashes of its distinct shingles, ascending. A-Z are lower-cased; fewer words than `words` are one shingle."""
    raws = [(t or "").encode().lower() for t in texts]  # of bytes: only A-Z change
    w, start = word_hashes(b"\n".join(raws))
    first = np.searchsorted(start, np.cumsum([0, *[len(r) + 1 for r in raws]])).tolist()
    h, out = runs(w, words), []
    for a, b in zip(first, first[1:], strict=False):
        if a == b:
            out.append(np.zeros(0, np.int64))
            continue
        s = np.sort(h[a : b - words + 1]) if b - a >= words else runs(w[a:b], b - a)
        new = np.empty(len(s), bool)
        new[0] = True
        np.not_equal(s[1:], s[:-1], out=new[1:])
        out.append(s[new])
    return out


def set_id(s: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(s.tobytes(), seed=len(s))], np.uint64).view(np.int64)[0])


def least_overlap(a: int, b: int, percent: int) -> int:
    """The least overlap at which sets of sizes a and b link: 100 o >= percent (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


@dataclass
class Tree:
    """A path-compressed prefix tree of ascending arrays. low, high: sizes of the sets at or below; depth: up to the run's end."""

    run: np.ndarray
    depth: int = 0
    low: int = 1 << 60
    high: int = 0
    ends: list = field(default_factory=list)
    next: dict = field(default_factory=dict)

    def add(self, s: np.ndarray, name) -> None:
        node, at = self, 0
        while True:
            node.low, node.high = min(node.low, len(s)), max(node.high, len(s))
            if at == len(s):
                node.ends.append((name, len(s)))
                return
            child = node.next.get(int(s[at]))
            if child is None:
                node.next[int(s[at])] = Tree(s[at:], len(s), len(s), len(s), [(name, len(s))])
                return
            both = min(len(child.run), len(s) - at)
            differ = np.flatnonzero(child.run[:both] != s[at : at + both])
            same = int(differ[0]) if len(differ) else both
            if same < len(child.run):  # split the run
                upper = Tree(child.run[:same], child.depth - len(child.run) + same, child.low, child.high)
                upper.next[int(child.run[same])] = child
                child.run = child.run[same:]
                node.next[int(s[at])] = child = upper
            node, at = child, at + same

    def linked(self, probe: np.ndarray, percent: int) -> list:
        """Names of the stored sets that link with the probe."""
        out, stack = [], [(self, 0)]
        while stack:
            node, overlap = stack.pop()
            rest = len(probe)
            if len(node.run):
                at = np.searchsorted(probe, node.run)
                inside = at < len(probe)
                overlap += int((probe[at[inside]] == node.run[inside]).sum())
                rest = len(probe) - int(np.searchsorted(probe, node.run[-1], "right"))
            out += [name for name, n in node.ends if 100 * overlap >= percent * (n + len(probe) - overlap)]
            if node.next and overlap + min(rest, node.high - node.depth) >= least_overlap(node.low, len(probe), percent):
                stack += [(child, overlap) for child in node.next.values()]
        return out


def base_rows(docs: DataFrame, words: int, every: int) -> DataFrame:
    """doc_id, hash of the text, n, node of each row; of every so many nodes also the set, once a task."""

    def run(batches):
        seen = set()
        for batch in sliced(batches):
            size, node, some = [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), words):
                k = set_id(s)
                size.append(len(s))
                node.append(k)
                pick = len(s) and k % every == 0 and k not in seen
                if pick:
                    seen.add(k)
                some.append(s if pick else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(some, pa.list_(pa.int64()))], ["doc_id", "h", "n", "node", "some"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")), run, "doc_id long, h long, n long, node long, some array<long>")


def prefix_rows(docs: DataFrame, sent, late: bool, words: int, percent: int) -> DataFrame:
    """gram, node, kind for each n-gram in each node's prefix that is a common one (late) or not; each node once a task.

    sent: a broadcast of the common n-grams, ascending, and their places in the order.
    """

    def run(batches):
        seen, (common, place) = set(), sent.value
        for batch in sliced(batches):
            grams, nodes, kinds = [], [], []
            for s in shingle_sets(batch.column(0).to_pylist(), words):
                if (n := len(s)) and (k := set_id(s)) not in seen:
                    seen.add(k)
                    p = prefix_length(n, percent)
                    if len(common):
                        at = np.searchsorted(common, s)
                        at[at == len(common)] = 0
                        known = common[at] == s
                        rare = s[~known]
                        s = s[known][np.argsort(place[at[known]])][: max(0, p - len(rare))] if late else rare[:p]
                    else:
                        s = s[:0] if late else s[:p]
                    grams.append(s)
                    nodes.append(k)
                    kinds.append(int(np.log(n) / np.log(LIKE_SIZE)))
            count = [len(g) for g in grams]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams) if grams else np.zeros(0, np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), count)), pa.array(np.repeat(np.array(kinds, np.int32), count))], ["gram", "node", "kind"])

    return mapped(docs.select("text"), run, "gram long, node long, kind int")


def columns(batch: pa.Table, *names: str) -> list[np.ndarray]:
    return [batch.column(k).to_numpy() for k in names]


def shared_grams(batch: pa.Table) -> pa.Table:
    """Of a bucket: the rows of n-grams that two or more nodes have, with the least node of like size as hub."""
    gram, node, kind = columns(batch, "gram", "node", "kind")
    order = np.lexsort((node, kind, gram))
    gram, node, kind = gram[order], node[order], kind[order]
    keep = np.concatenate([[True], (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])])
    gram, node, kind = gram[keep], node[keep], kind[keep]
    new = np.concatenate([[True], gram[1:] != gram[:-1]])
    many = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
    begin = np.flatnonzero(new | np.concatenate([[True], kind[1:] != kind[:-1]]))
    hub = np.repeat(node[begin], np.diff(np.append(begin, len(node))))
    return pa.table({"gram": gram[many], "node": node[many], "hub": hub[many]})


def shared_prefixes(docs: DataFrame, common: np.ndarray, place: np.ndarray, rows: int, words: int, percent: int) -> DataFrame:
    """gram, node, hub for the prefix n-grams that nodes share.

    What isn't common is few rows an n-gram, and is dealt to buckets by it. A common n-gram may be that of a third
    of the nodes: its hubs are an aggregate, combined before the shuffle, and are joined back by n-gram and size.
    """
    sent = docs.sparkSession.sparkContext.broadcast((common, place))  # MOST_COMMON numbers at most
    bucket = F.pmod(F.xxhash64("gram"), F.lit(max(1, round(rows / BUCKET_ROWS)))).alias("_b")
    rare = prefix_rows(docs, sent, False, words, percent).groupBy(bucket).applyInArrow(shared_grams, "gram long, node long, hub long")
    if not len(common):
        return rare
    late = durable(prefix_rows(docs, sent, True, words, percent).distinct())
    hubs = durable(late.groupBy("gram", "kind").agg(F.min("node").alias("hub")))
    return rare.unionByName(late.join(hubs, ["gram", "kind"]).select("gram", "node", "hub"))


def needs(a: str, b: str, percent: int) -> str:
    """SQL: how many prefix n-grams sets of sizes a and b that link share at least.

    What two sets share is in both prefixes, or in the rest of the one whose prefix ends first.
    """
    rest = [f"floor(({percent} * {k} + 99) / 100) - 1" for k in (a, b)]
    return f"greatest(1, ceil({percent} * ({a} + {b}) / {100 + percent}) - greatest({rest[0]}, {rest[1]}))"


def enough(counts: DataFrame, percent: int) -> DataFrame:
    """Rows of counts (n, low, high, shared) that may link with a set of low to high n-grams.

    Up to size n the need grows with the size, so it is least at the low end. From there on it is over f and
    less than f + 2, where f falls by percent ** 2 / (100 (100 + percent)) a size: a lesser need than that of
    the high end is at one of the few sizes below it only. So this is the least need of all sizes that may link.
    """
    ends = counts.withColumn("_l", F.expr(f"greatest(low, ceil({percent} * n / 100))")).withColumn("_h", F.expr(f"least(high, floor(100 * n / {percent}))"))
    steps = (100 * (100 + percent) - 1) // (percent * percent)  # times the fall are less than 1
    sizes = ["_l", *[f"greatest(_l, _h - {k})" for k in range(steps + 1)]]
    return ends.where("_l <= _h").where(f"shared >= least({', '.join(needs('n', k, percent) for k in sizes)})").drop("_l", "_h")


def needed_filter(nodes: DataFrame) -> np.ndarray:
    """A filter of the distinct nodes (k): 64-bit words with three bits a node, 16 bits for each up to 8 million nodes, 16 MB at most; of more nodes more others pass."""
    count, words = nodes.count(), 64
    while words * 4 < count and words < BLOOM_WORDS:
        words *= 2
    mask = functools.reduce(lambda a, b: a.bitwiseOR(b), [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(k, {at}) & 63 as int))") for at in (24, 32, 40)])
    bits = nodes.groupBy(F.pmod("k", F.lit(words)).alias("w")).agg(F.bit_or(mask).alias("m")).toPandas()  # `words` rows at most
    out = np.zeros(words, np.uint64)
    out[bits["w"].to_numpy()] = bits["m"].to_numpy().view(np.uint64)
    return out


def passes(bits: np.ndarray, k: int) -> bool:
    u = k & 0xFFFFFFFFFFFFFFFF
    word = int(bits[k % len(bits)])
    return all(word >> ((u >> at) & 63) & 1 for at in (24, 32, 40))


def sets_of(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, set (8 bytes an n-gram) of the nodes (k), each once, and of a few others that pass the filter."""
    sent = docs.sparkSession.sparkContext.broadcast(needed_filter(nodes))

    def run(batches):
        seen, bits = set(), sent.value
        for batch in sliced(batches):
            nodes, sets = [], []
            for s in shingle_sets(batch.column(0).to_pylist(), words):
                if len(s) and (k := set_id(s)) not in seen and passes(bits, k):
                    seen.add(k)
                    nodes.append(k)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "set"])

    return mapped(docs.select("text"), run, "node long, set binary").groupBy("node").agg(F.first("set").alias("set"))


def forest(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Those of the links (a, b) that join nodes which the links before them leave apart."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    out: tuple[list[int], list[int]] = ([], [])
    for x, y in zip(a, b, strict=True):
        if (r := root(x)) != (q := root(y)):
            up[r] = q
            out[0].append(x)
            out[1].append(y)
    return out


def links(docs: DataFrame, stored: DataFrame, probes: DataFrame, words: int, percent: int, turns: int = 1) -> DataFrame:
    """Links a, b between nodes of probes (key, node, n) and of stored (key, node, n) under their keys.

    Of the links that a task finds, those that join nothing new are left out: the classes are the same, and
    a task gives fewer links than it has nodes, whatever the size of the group. Keys are worked off in so
    many turns, so that only a part of the sets is on disk at once.
    """

    def run(batch: pa.Table) -> pa.Table:
        key, node = columns(batch, "key", "node")
        probe = batch.column("probe").to_numpy().astype(bool)
        sets = batch.column("set").combine_chunks()
        trees: dict[int, Tree] = {}
        for i in np.flatnonzero(~probe).tolist():
            trees.setdefault(key[i], Tree(np.zeros(0, np.int64))).add(np.frombuffer(sets[i].as_buffer(), np.int64), int(node[i]))
        a, b = [], []
        for i in np.flatnonzero(probe).tolist():
            if tree := trees.get(key[i]):
                found = [k for k in tree.linked(np.frombuffer(sets[i].as_buffer(), np.int64), percent) if k != node[i]]
                b += found
                a += [int(node[i])] * len(found)
        a, b = forest(a, b)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = durable(stored.withColumn("probe", F.lit(False)).unionByName(probes.withColumn("probe", F.lit(True))).withColumn("_t", F.pmod(F.xxhash64("key", F.lit(5)), F.lit(turns))))
    out = None
    for turn in range(turns):
        some = rows.where(F.col("_t") == turn).drop("_t")
        sets = sets_of(docs, some.select(F.col("node").alias("k")).distinct(), words)
        groups = max(1, -(-(some.agg(F.sum("n")).first()[0] or 0) // GROUP_SHINGLES))
        found = durable(some.join(sets, "node").groupBy(F.pmod(F.xxhash64("key"), F.lit(groups)).alias("_g")).applyInArrow(run, "a long, b long"))
        out = found if out is None else out.unionByName(found)
    release(rows)
    return out


def dealt(rows: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """rows (by, node, n) as (key, node, n), and all keys as (by, key): of about BLOCK rows and BLOCK_SHINGLES n-grams a key at most, or one row."""
    load = durable(rows.groupBy(by).agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("salts")))
    key = F.xxhash64(F.col(by), F.col("salt")).alias("key")
    salted = rows.join(load, by).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).select(key, "node", "n")
    return salted, load.select(by, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select(by, key)


def components(edges: DataFrame) -> DataFrame:
    """id, class (the least id reachable) for each end of edges (a, b), by alternating large and small stars.

    The least neighbours are a table of their own, so Spark can split the join of a node with a great many edges.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = durable(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
            out = durable(both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        else:
            down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            least = durable(down.groupBy("a").agg(F.min("b").alias("m")))
            moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            out = durable(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        release(e, least)
        return out

    e = durable(edges.where("a <> b").select("a", "b").distinct())
    before = state(e)
    while before[0]:
        e = star(star(e, True), False)
        if (now := state(e)) == before:
            break
        before = now
    return e.select(F.col("a").alias("id"), F.col("b").alias("class")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("class")).distinct())


def common_grams(some: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of sampled sets (some): the common n-grams, ascending, and their places in the global order, the rarer first."""
    often = some.select(F.explode("some").alias("gram")).groupBy("gram").count().where(F.col("count") >= COMMON_AT)
    often = often.orderBy(F.desc("count"), "gram").limit(MOST_COMMON).toPandas().sort_values(["gram"])
    gram = often["gram"].to_numpy(np.int64)
    return gram, np.lexsort((gram, often["count"].to_numpy(np.int64))).argsort()


def block_probes(known: DataFrame, percent: int) -> DataFrame:
    """block, node, n: the nodes of known (gram, node, n, block, cell, low, high, class) that may link with a node of a block.

    Counted for each cell (nodes of a block of like size): how many n-grams a node shares with nodes of other classes
    in the cell. Of two cells, the one that is first in order has the probes. What is joined are nodes with cells of
    an n-gram, without those all of the node's own class, so a group that is one class gives no rows.
    """
    cells = known.groupBy("gram", F.col("block").alias("b"), F.col("cell").alias("c")).agg(F.first("low").alias("l"), F.first("high").alias("h"), F.min("class").alias("c1"), F.max("class").alias("c2"))
    later = "(b > block or b = block and c >= cell)"
    fit = f"{percent} * n <= 100 * h and {percent} * l <= 100 * n"
    met = known.drop("low", "high").join(cells, "gram").where(f"{later} and (c1 <> class or c2 <> class) and {fit}")
    counts = met.groupBy("node", "b", "c").agg(F.count(F.lit(1)).alias("shared"), *[F.first(k).alias(k) for k in ("n", "l", "h")])
    return enough(counts.withColumnsRenamed({"l": "low", "h": "high"}), percent).select(F.col("b").alias("block"), "node", "n").distinct()


def classed(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h (hash of the text), n, node) for each row of docs (doc_id, text), and (node, class) of the nodes that have links."""
    docs = docs.select("doc_id", "text")
    first = durable(base_rows(docs, words, SAMPLE_EVERY))
    common, place = common_grams(first.where(F.col("some").isNotNull()).groupBy("node").agg(F.first("some").alias("some")))
    base = durable(first.drop("some"))
    release(first)
    rows = base.agg(F.sum(F.expr(f"n - floor(({percent} * n + 99) / 100) + 1"))).first()[0] or 0
    dense = durable(shared_prefixes(docs, common, place, rows, words, percent))
    nodes = durable(base.where("n > 0").groupBy("node").agg(F.first("n").alias("n")).join(dense.select("node").distinct(), "node", "left_semi"))

    # star round
    star = dense.where("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("shared"))
    star = star.join(nodes, "node").join(nodes.toDF("hub", "n_hub"), "hub")
    tight = F.expr("if(20 * shared >= n, shared, 0)").alias("tight")
    best = F.max(F.struct(tight, F.expr("hub ^ -1L").alias("first"), "hub", "n", "n_hub", "shared")).alias("_s")
    star = durable(star.groupBy("node").agg(best).select("node", "_s.hub", "_s.n", "_s.n_hub", "_s.shared", (F.col("_s.tight") == 0).alias("loose")))
    stored, keys = dealt(star.where(f"not loose and shared >= {needs('n', 'n_hub', percent)}").select("hub", "node", "n"), "hub")
    probes = keys.join(nodes.toDF("hub", "n"), "hub").select("key", F.col("hub").alias("node"), "n")
    near = durable(components(links(docs, stored, probes, words, percent)))

    # block round: each node's block, and the cell of like size in it
    hubs = star.groupBy(F.col("hub").alias("node")).agg(F.min("loose").alias("also"))
    owner = nodes.join(star.select("node", "hub", "loose"), "node", "left").join(hubs, "node", "left")
    owner = owner.select(F.xxhash64(F.coalesce("hub", "node"), F.coalesce("loose", "also", F.lit(False))).alias("hub"), "node", "n")
    member = dealt(owner, "hub")[0].withColumnRenamed("key", "block").withColumn("cell", F.floor(F.log("n") / np.log(CELL_SIZE)).cast("int"))
    member = durable(member.join(near.toDF("node", "class"), "node", "left").withColumn("class", F.coalesce("class", "node")))
    ends = member.groupBy("block", "cell").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    known = durable(dense.select("gram", "node").join(member.join(ends, ["block", "cell"]), "node"))
    release(dense)
    probes = durable(block_probes(known, percent))
    release(known)
    probes, keys = dealt(probes, "block")
    more = links(docs, member.select("block", "node", "n").join(keys, "block").select("key", "node", "n"), probes, words, percent, TURNS)
    classes = durable(components(near.select(F.col("id").alias("a"), F.col("class").alias("b")).unionByName(more)).toDF("node", "class"))
    release(star, nodes, member, near)
    return base, classes


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id of the class) for each row of docs (doc_id, text)."""
    base, classes = classed(docs, words, percent)
    own = durable(base.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")))
    linked = classes.join(own, "node")
    least = durable(linked.groupBy("class").agg(F.min("least").alias("least")))
    # the least of all nodes, linked or not: a table, so Spark can split the join of a node with a great many rows
    named = durable(own.join(classes.join(least, "class").select("node", F.col("least").alias("of_class")), "node", "left").select("node", F.coalesce("of_class", "least").alias("least")))
    release(own)
    return base.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each class of docs, all columns: of the least doc_id (null last), then the least hash of the text, then of the row.

    Rows without words are classes of their own, and all stay.
    """
    id_, text, names = F.col("doc_id").cast("long"), F.col("text"), docs.columns
    base, classes = classed(docs, words, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "rows")).alias("_s")
    own = base.where("n > 0").groupBy("node", "doc_id", "h").agg(F.count(F.lit(1)).alias("rows")).groupBy("node").agg(first)
    ones = own.join(classes, "node", "left").groupBy(F.coalesce("class", "node").alias("class")).agg(F.min("_s").alias("_s"))
    ones = durable(ones.select(F.col("_s.doc_id").alias("_one"), F.col("_s.h").alias("_h"), F.col("_s.rows").alias("_rows")))
    release(base, classes)
    some = F.coalesce(text.rlike(WORD), F.lit(False))

    def of(these: DataFrame) -> DataFrame:
        return docs.where(some).join(these, id_.eqNullSafe(these["_one"]) & (F.xxhash64(text) == these["_h"]), "left_semi")

    # few: only rows with equal doc_id and text have to be told apart by their other columns
    again = of(ones.where("_rows > 1")).groupBy(id_.alias("_one"), F.xxhash64(text).alias("_h")).agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("_s"))
    return docs.where(~some).unionByName(of(ones.where("_rows = 1"))).unionByName(again.select(*[F.col("_s")[k].alias(k) for k in names]))
