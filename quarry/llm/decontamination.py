"""Benchmark decontamination by suffix arrays of the training texts.

A test item's window is `window` consecutive words (see words.py) of it; an item of fewer words, but not none, is one
window. Texts of documents are taken in shards of about `shard` words, a document never cut. In a shard the words get the numbers
of the test vocabulary, and a suffix array sorts all places from which test words go on. Every test suffix is looked up in every shard by
binary search, all suffixes at once: its longest verbatim match, and, where that reaches the suffix's window, the range of
places that have the window. Those places are marked in their documents; what is marked is hit.

What can't be part of a window is left out of the array before it is sorted: a word that no test item has, or a pair of words that
stands in none, ends a stretch, and a stretch shorter than the shortest window has none. Places are sorted as far as the
longest test suffix or the longest stretch, whichever is shorter. Windows that are alike are looked up once, so copies among the items cost nothing.

The test words are sent to all tasks: `block_words` words at most, in pieces that overlap by a window; a larger benchmark goes
in several passes over the documents, whose results are put together by document, so it may be of any size.

Null text has no words and is never contaminated; an item without words is in no document. A null item_id is named by empty text; items that
share an item_id are one item. Repeated documents are judged alike, each for itself. Empty documents give an empty result, and an
empty benchmark hits nothing. Other columns are not read, but drop_contaminated() keeps them.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import durable, sliced
from quarry.llm.words import chunks, words

SHARD, BLOCK_WORDS, PIECE_WORDS = 1 << 19, 1 << 20, 1 << 15


@dataclass
class Tests:
    """Test texts as numbers of words, from 1, with a 0 after each; the distinct windows, and the items that have each."""

    vocabulary: dict[bytes, int]
    text: np.ndarray
    left: np.ndarray  # words from each place to the end of its text
    pairs: np.ndarray  # pairs of words that stand side by side, sorted
    starts: np.ndarray  # of each window, a place where it stands
    sizes: np.ndarray
    first_item: np.ndarray  # of each window, where its items begin in `items`
    items: np.ndarray
    names: list[str]


def number(text: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    """A text's words as numbers of the vocabulary; 0 for others."""
    parts = [np.fromiter(map(vocabulary.get, w, repeat(0)), np.int32, len(w)) for w in chunks(text)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def prepared(pieces: list[tuple[str, bytes]], window: int) -> Tests:
    """pieces: name of an item, text; a text of fewer words than the window is a whole item."""
    vocabulary: dict[bytes, int] = {}
    texts, names = [], sorted({name for name, _ in pieces})
    place = {name: k for k, name in enumerate(names)}
    for _, text in pieces:
        texts.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)], np.int32))
    windows: dict[bytes, tuple[int, int, set[int]]] = {}
    at = 0
    for (name, _), t in zip(pieces, texts, strict=True):
        m = min(window, len(t))
        for k in range(len(t) - m + 1 if m else 0):
            windows.setdefault(t[k : k + m].tobytes(), (at + k, m, set()))[2].add(place[name])
        at += len(t) + 1
    text = np.concatenate([np.append(t, 0) for t in texts]).astype(np.int32) if texts else np.zeros(0, np.int32)
    left = np.concatenate([np.arange(len(t), -1, -1) for t in texts]) if texts else np.zeros(0, np.int64)
    found = list(windows.values())
    counts = np.array([len(w[2]) for w in found], np.int64)
    return Tests(
        vocabulary, text, left, np.unique(pair(text)) if len(text) > 1 else np.zeros(0, np.int64),
        np.array([w[0] for w in found], np.int64), np.array([w[1] for w in found], np.int64),
        np.cumsum(counts) - counts, np.array([i for w in found for i in sorted(w[2])], np.int64), names,
    )


def pair(text: np.ndarray) -> np.ndarray:
    """Each word with the next as one number; 0 where either is a gap."""
    a, b = text[:-1].astype(np.int64), text[1:].astype(np.int64)
    return np.where((a > 0) & (b > 0), (a << 32) | b, 0)


def stretches(text: np.ndarray, tests: Tests, shortest: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The words that may be in a window, with a 0 after each stretch of them; where each is in the text (-1 for a gap); words of the longest stretch."""
    known = text > 0
    goes_on = np.zeros(len(text), bool)  # a test text has this word and the next side by side
    both = pair(text)
    if len(both) and len(tests.pairs):
        at = np.minimum(np.searchsorted(tests.pairs, both), len(tests.pairs) - 1)
        goes_on[:-1] = (both > 0) & (tests.pairs[at] == both)
    first, last = np.flatnonzero(known & ~np.r_[False, goes_on[:-1]]), np.flatnonzero(known & ~goes_on)
    length = last - first + 1
    keep = length >= shortest
    first, length = first[keep], length[keep]
    if not len(first):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), 0
    start = np.cumsum(length + 1) - (length + 1)
    out, place = np.zeros(int(length.sum()) + len(first), np.int32), np.full(int(length.sum()) + len(first), -1, np.int64)
    inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    to, at = np.repeat(start, length) + inside, np.repeat(first, length) + inside
    out[to], place[to] = text[at], at
    return out, place, int(length.max())


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of the words (not of gaps), sorted by what follows them up to `depth` words or a gap at least: the order's range doubles until it is enough."""
    n = len(text)
    rank, reach = text.astype(np.int64), 1
    while reach < depth:
        after = np.zeros(n, np.int64)
        after[: n - reach] = rank[reach:]
        after[text == 0] = 0
        both = np.where(rank > 0, rank * (n + int(rank.max()) + 2) + after, 0)
        order = np.argsort(both, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[0, np.diff(both[order]) != 0])
        rank = np.where(text == 0, 0, new + 1)
        reach *= 2
    order = np.argsort(rank, kind="stable")
    return order[text[order] > 0]


def common(text: np.ndarray, at: np.ndarray, tests: Tests, test: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words the text from `at` and the test text from `test` have in common, up to `most`."""
    n = np.zeros(len(at), np.int64)
    going = np.flatnonzero((at >= 0) & (most > 0))
    step = 8
    while len(going):
        off = n[going, None] + np.arange(step)
        i, j = at[going, None] + off, test[going, None] + off
        a = np.where(i < len(text), text[np.minimum(i, len(text) - 1)], -1)
        b = np.where(j < len(tests.text), tests.text[np.minimum(j, len(tests.text) - 1)], -2)
        same = (a == b) & (a > 0)
        more = np.where(same.all(axis=1), step, same.argmin(axis=1))
        n[going] = np.minimum(n[going] + more, most[going])
        going = going[(more == step) & (n[going] < most[going])]
        step = min(step * 2, 256)
    return n


def searched(text: np.ndarray, order: np.ndarray, tests: Tests, test: np.ndarray, size: np.ndarray, above: bool) -> np.ndarray:
    """For each test place, the first place in `order` whose suffix isn't before (above: comes after) its first `size` words."""
    low, high = np.zeros(len(test), np.int64), np.full(len(test), len(order), np.int64)
    while len(going := np.flatnonzero(low < high)):
        mid = (low[going] + high[going]) // 2
        at, q, m = order[mid], test[going], size[going]
        n = common(text, at, tests, q, m)
        i, j = at + n, q + n
        a, b = np.where(i < len(text), text[np.minimum(i, len(text) - 1)], 0), tests.text[np.minimum(j, len(tests.text) - 1)]
        right = np.where(n == m, above, a < b)  # the sought place is after mid
        low[going[right]] = mid[right] + 1
        high[going[~right]] = mid[~right]
    return low


@dataclass
class Found:
    longest: np.ndarray  # of each test place, the words of its longest match in the shard
    where: np.ndarray  # and one place in the shard that has it, -1 if none
    window: np.ndarray  # the windows with occurrences: their numbers
    low: np.ndarray  # and their ranges of the array
    high: np.ndarray


def matched(text: np.ndarray, order: np.ndarray, tests: Tests) -> Found:
    """Longest match of every test suffix, and ranges of the windows that occur."""
    every = np.flatnonzero(tests.text > 0)
    longest, where = np.zeros(len(tests.text), np.int64), np.full(len(tests.text), -1, np.int64)
    if not len(order) or not len(every):
        return Found(longest, where, *(np.zeros(0, np.int64) for _ in range(3)))
    at = searched(text, order, tests, every, tests.left[every], False)
    for side in (at - 1, at):  # a suffix's best match is beside where it would be
        there = (side >= 0) & (side < len(order))
        place = np.where(there, order[np.clip(side, 0, len(order) - 1)], -1)
        n = common(text, place, tests, every, tests.left[every])
        better = n > longest[every]
        longest[every[better]], where[every[better]] = n[better], place[better]
    window = np.flatnonzero(longest[tests.starts] >= tests.sizes)
    q, m = tests.starts[window], tests.sizes[window]
    return Found(longest, where, window, searched(text, order, tests, q, m, False), searched(text, order, tests, q, m, True))


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
HITS = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(SPAN)), ("items", pa.list_(pa.string()))])
HITS_DDL = "struct<n_words: long, n_hit: long, spans: array<struct<start: long, end: long>>, items: array<string>>"


class Shard:
    """Texts (word numbers) searched together."""

    def __init__(self, texts: list[np.ndarray], tests: Tests):
        self.texts, self.tests = texts, tests
        sizes = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(sizes + 1) - (sizes + 1)
        whole = np.zeros(int((sizes + 1).sum()), np.int32)
        for b, t in zip(self.begin, texts, strict=True):
            whole[b : b + len(t)] = t
        self.size = len(whole)
        text, self.place, stretch = stretches(whole, tests, int(tests.sizes.min(initial=1 << 40)))
        self.order = suffix_array(text, min(stretch, int(tests.left.max(initial=0))))
        self.found = matched(text, self.order, tests)

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, at, "right") - 1

    def hits(self) -> list[dict]:
        """HITS of each text: marks of all places in the windows' ranges."""
        found, tests = self.found, self.tests
        counts = found.high - found.low
        which = np.repeat(np.arange(len(counts)), counts)
        at = self.place[self.order[np.repeat(found.low, counts) + np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)]]
        window = found.window[which]
        change = np.zeros(self.size + 1, np.int32)
        np.add.at(change, at, 1)
        np.add.at(change, at + tests.sizes[window], -1)
        spans = np.flatnonzero(np.diff(np.r_[False, np.cumsum(change) > 0, False])).reshape(-1, 2)
        known = np.unique(self.document(at) * max(1, len(tests.sizes)) + window)  # a document's windows, once each
        owner, window = known // max(1, len(tests.sizes)), known % max(1, len(tests.sizes))
        span_owner, last = self.document(spans[:, 0]), np.append(tests.first_item[1:], len(tests.items))
        out = [{"n_words": len(t), "n_hit": 0, "spans": [], "items": []} for t in self.texts]
        for d in np.unique(owner):
            mine = spans[slice(*np.searchsorted(span_owner, [d, d + 1]))] - self.begin[d]
            items = {int(i) for w in window[slice(*np.searchsorted(owner, [d, d + 1]))] for i in tests.items[tests.first_item[w] : last[w]]}
            out[d] |= {"n_hit": int((mine[:, 1] - mine[:, 0]).sum()), "spans": [{"start": int(a), "end": int(b)} for a, b in mine], "items": sorted(tests.names[i] for i in items)}
        return out

    def longest(self) -> list[tuple[int, int, int, int]]:
        """Of each item the longest match that holds a window: item, words, text, first word in the text."""
        size, where, best = self.found.longest, self.found.where, {}
        for w in self.found.window:
            q = int(self.tests.starts[w])
            at = int(self.place[where[q]])
            d = int(self.document(np.array([at]))[0])
            for i in self.tests.items[self.tests.first_item[w] :][: self.count(w)]:
                if int(i) not in best or best[int(i)][1] < size[q]:
                    best[int(i)] = (int(i), int(size[q]), d, int(at - self.begin[d]))
        return list(best.values())

    def count(self, w: int) -> int:
        return int((self.tests.first_item[w + 1] if w + 1 < len(self.tests.first_item) else len(self.tests.items)) - self.tests.first_item[w])


def shards(batches, text: int, tests: Tests, shard: int):
    """Batches in lists of about `shard` words, with the word numbers of their texts; a text is never cut."""
    held, numbers, n = [], [], 0
    for batch in sliced(batches):
        held.append(batch)
        for t in batch.column(text):
            numbers.append(number(t.as_py() or b"", tests.vocabulary))
            n += len(numbers[-1])
        if n >= shard:
            yield held, numbers
            held, numbers, n = [], [], 0
    if held:
        yield held, numbers


def test_blocks(benchmark: DataFrame, window: int, block_words: int):
    """The benchmark (item_id, text) as Tests of at most about block_words words each; one block is on the driver at a time."""
    step = PIECE_WORDS - (window - 1) if PIECE_WORDS > 2 * window else window + 1

    def cut(batches):
        for batch in sliced(batches):
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held: list[bytes] = []
                for part in chunks(text.as_py()):
                    held += part
                    while len(held) >= step + 2 * (window - 1) + 1:  # what stays is a window at least, so no piece is taken for a short item
                        yield piece(name, held[: step + window - 1])
                        held = held[step:]
                if held:
                    yield piece(name, held)

    def piece(name: str, some: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b" ".join(some)], pa.binary()), pa.array([len(some)], pa.int64())], ["name", "text", "n"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("binary").alias("text")).where("text is not null")
    pieces = durable(rows.mapInArrow(cut, "name string, text binary, n long").distinct())
    blocks = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // block_words))
    for k in range(blocks):
        here = pieces.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == k).collect()
        yield k, blocks, prepared(sorted((r["name"], bytes(r["text"])) for r in here), window)


def marked(docs: DataFrame, text: str, tests: Tests, name: str, shard: int) -> DataFrame:
    """docs with the column `name`, HITS of each row; `text` is binary."""
    sent = docs.sparkSession.sparkContext.broadcast(tests)  # block_words words at most
    at = docs.columns.index(text)

    def run(batches):
        for held, numbers in shards(batches, at, sent.value, shard):
            hits, upto = Shard(numbers, sent.value).hits(), 0
            for batch in held:
                mine = pa.array(hits[upto : upto + batch.num_rows], HITS)
                upto += batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns, mine], [*batch.schema.names, name])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, {name} {HITS_DDL}")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard: int = SHARD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, spans (stretches of hit words, `end` not included) and items (their ids as strings, sorted) for each row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    out: DataFrame | None = None
    for k, blocks, tests in test_blocks(benchmark, window, block_words):
        if blocks == 1:
            return marked(rows, "text", tests, "h", shard).select("doc_id", "h.*")
        found = marked(rows, "text", tests, "h", shard).select("doc_id", F.sha2("text", 256).alias("_d"), "h.*")
        found = durable(found if k == 0 else found.where("n_hit > 0").drop("n_words").distinct())
        first = found if k == 0 else first  # noqa: F821  set by the first block
        some = found.where("n_hit > 0").select("doc_id", "_d", "spans", "items").distinct()
        out = some if out is None else out.unionByName(some)
    assert out is not None
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    met = out.groupBy("doc_id", "_d").agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    met = met.withColumn("spans", joined_spans(F.col("spans"))).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]))
    both = first.select(F.col("doc_id").alias("_id"), "_d", "n_words").join(durable(met).withColumnRenamed("_d", "_e"), F.col("_id").eqNullSafe(F.col("doc_id")) & F.col("_d").eqNullSafe(F.col("_e")), "left")
    return both.select(F.col("_id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("spans", F.array().cast("array<struct<start: long, end: long>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def joined_spans(spans: Column) -> Column:
    """Sorted stretches, those that touch or overlap as one."""

    def put(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        apart = (F.size(out) == 0) | (x["start"] > F.coalesce(F.try_element_at(out, F.lit(-1))["end"], F.lit(-1)))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(apart, F.array_append(out, x)).otherwise(F.array_append(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), grown))

    return F.aggregate(spans, F.array().cast("array<struct<start: long, end: long>>"), put)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard: int = SHARD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs (text), with all their columns, in which no window of the benchmark occurs."""
    kept, binary, name = docs, "_bytes", "_hits"
    while {binary, name} & set(docs.columns):
        binary, name = binary + "_", name + "_"
    for _, _, tests in test_blocks(benchmark, window, block_words):
        seen = marked(kept.withColumn(binary, F.col("text").cast("binary")), binary, tests, name, shard)
        kept = seen.where(F.col(f"{name}.n_hit") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard: int = SHARD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """item_id, n_words, doc_id, start: of each item with an occurring window its longest verbatim match (in pieces of PIECE_WORDS words), and one document and word where it is: the least."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    out: DataFrame | None = None
    for _, _, tests in test_blocks(benchmark, window, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(tests)

        def run(batches, sent=sent):
            for held, numbers in shards(batches, 1, sent.value, shard):
                ids = [x for batch in held for x in batch.column(0).to_pylist()]
                best = [(sent.value.names[i], n, ids[d], at) for i, n, d, at in Shard(numbers, sent.value).longest()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*best, strict=True) if best else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["item_id", "n_words", "doc_id", "start"])

        part = rows.mapInArrow(run, "item_id string, n_words long, doc_id long, start long")
        out = part if out is None else out.unionByName(part)
    assert out is not None
    best = out.groupBy("item_id").agg(F.min(F.struct(-F.col("n_words"), "doc_id", "start")).alias("b"))
    return best.select("item_id", (-F.col("b.col1")).alias("n_words"), "b.doc_id", "b.start")
