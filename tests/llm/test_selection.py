"""Importance resampling, hard negatives and decontamination against plain versions, on odd inputs, and in many parts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontamination, hard_negatives, queries, resampling
from quarry.llm.common import durable, release, scratch, shared_folder, sliced, table
from quarry.llm.words import chunks, words

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def text_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows, extra columns with clashing names."""
    long = " ".join(f"w{i % 977} the" for i in range(60_000))
    rows = [(1, ""), (2, None), (3, "one two THREE"), (3, "one two THREE"), (3, "one two THREE"), (None, "four  five\n" * 12), (None, "four  five\n" * 12), (5, long), (6, " \t\n"), (7, "x" * 70_000), (8, "é1 Ünï \U0001f600 İ ſ " * 9), (-9, "one two three four " * 8)]
    return spark.createDataFrame([(*r, 1, 0.5, [2], 7, "q") for r in rows], "doc_id long, text string, n_words int, score double, h array<int>, bucket int, rank string")


@pytest.mark.parametrize("text", ["", "A b-c_d Éa\x00zZ9", "ab " * 50, "İstanbul x"])
@pytest.mark.parametrize("size", [1, 4, 1 << 20])
def test_words(text, size):
    want = [w.encode() for w in plain_words(text)]
    assert words(text.encode()) == want
    assert [w for part in chunks(text.encode(), size) for w in part] == want


# resampling


def plain_resample(docs, target, longest, buckets, seed, least, percent):
    def features(text):
        w = plain_words(text)
        return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)))
    for text in target:
        t.update(map(bucket, features(text)))
    out = []
    for doc_id, text in docs:
        f = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (t_s + buckets) / ((s[b] + 1) * (t_t + buckets)))) for t_s, t_t in [(sum(s.values()), sum(t.values()))] for b in map(bucket, f))
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(plain_words(text))])
    enough = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    rows = Counter()
    for k, r in enumerate(enough):
        rows[(*r[:4], k + 1 if k < percent * len(enough) // 100 else None)] += 1
    return rows + Counter((*r[:4], None) for r in out if r[4] < least)


@pytest.mark.parametrize(("longest", "percent", "least"), [(1, 10, 20), (2, 50, 1), (3, 100, 0), (1, 0, 0), (1, 34, 3)])
def test_resampling_against_plain(spark, longest, percent, least):
    docs, target = text_rows(spark), spark.createDataFrame([(1, "the one two"), (2, None), (2, "")], "item_id long, text string")
    got = resampling.resample(docs, target, longest=longest, buckets=50, seed=7, least_words=least, percent=percent).collect()
    want = plain_resample([(r.doc_id, r.text) for r in docs.collect()], ["the one two", ""], longest, 50, 7, least, percent)
    assert Counter(tuple(r) for r in got) == want


def test_resampling_query(spark):
    docs, target = (table(spark, SMALL, n) for n in ("documents", "benchmark"))
    got = queries.op11_importance_resampling(spark, SMALL).collect()
    assert Counter(tuple(r) for r in got) == plain_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], 1, 10_000, 2024, 20, 10)


def test_drawn_documents(spark):
    docs = table(spark, SMALL, "documents")
    drawn = resampling.drawn_documents(docs, table(spark, SMALL, "benchmark"), percent=5)
    assert sorted(r["rank"] for r in drawn.collect()) == list(range(1, drawn.count() + 1))
    assert drawn.columns == [*docs.columns, "rank"]


@pytest.mark.parametrize("span", [(-(2**63), 2**63 - 1), (0, 3), (-5, 5), (2**40, 2**40 + 2**30), (-(2**62), -(2**62) + 10**6)])
def test_radix_selection_finds_each_place(spark, span):
    draw = random.Random(3)
    values = [draw.randint(*span) for _ in range(60)] + [span[0], span[1], span[1]]
    df = spark.createDataFrame([(v, k % 2) for k, v in enumerate(values)], "a long, b long").coalesce(1).cache()
    pairs = sorted((v, k % 2) for k, v in enumerate(values))
    for place in (1, 2, 31, len(pairs) - 1):
        last = resampling.last_drawn(df, [F.col("a"), F.col("b")], place)
        taken = [p for p in pairs if p[: len(last)] <= tuple(last)]
        assert taken[:place] == pairs[:place]
        assert len(taken) == place or taken[place:] == [pairs[place - 1]] * (len(taken) - place)
    df.unpersist()


# hard negatives


def plain_mine(rows, positives=5, negatives=3, low=50, high=95, every=50):
    rows = sorted({(i, y, tuple(math.floor(256 * x) for x in v)) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = Counter()
    for a in rows:
        if a[0] % every:
            continue
        near = sorted(((-sum(x * y for x, y in zip(a[2], r[2], strict=False)), r[0], r[1]) for r in rows if r[0] != a[0]))
        for s, i, _ in [r for r in near if r[2] == a[1]][:positives]:
            found = [r for r in near if r[2] != a[1] and low * -s <= 100 * -r[0] <= high * -s][:negatives]
            out.update((a[0], i, k + 1, r[1], -s, -r[0]) for k, r in enumerate(found))
    return out


def vectors(kind):
    draw = np.random.default_rng(4)
    rows = [(int(i), int(draw.integers(0, 4)), (draw.normal(0.2, 0.5, 7)).tolist()) for i in range(240)]
    if kind == "odd":
        rows += [(250, 1, None), (300, None, [1.0] * 7), (350, 1, [math.nan] * 7), (400, 1, [1.0, None]), (450, 1, [math.inf]), (None, 1, [1.0] * 7), (500, 2, []), (550, 2, [0.5, 0.5]), (550, 2, [0.5, 0.5]), (-50, 3, [0.25] * 7), (600, 9, [0.1] * 9)]
        rows += [(700 + k, k % 2, [0.4] * 7) for k in range(40)]  # ties
    if kind == "large":
        rows = [(i, y, [x * 3e5 for x in v]) for i, y, v in rows]
    return rows


@pytest.mark.parametrize("kind", ["plain", "odd", "large"])
@pytest.mark.parametrize("shape", [{}, {"row_block": 16, "anchor_block": 2, "chunk": 2, "round_bytes": 1}])
def test_hard_negatives_against_plain(spark, monkeypatch, kind, shape):
    if shape:
        monkeypatch.setattr(hard_negatives, "ROUND_X", 0)  # one block of anchors a round
    df = spark.createDataFrame([(*r, 5, "a", 1, 2.0) for r in vectors(kind)], "vec_id long, label int, embedding array<double>, id int, block string, q int, score double")
    got = hard_negatives.mine(df, F.col("id") % 50 == 0, **shape).collect()
    assert Counter(tuple(r) for r in got) == plain_mine(vectors(kind))


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(df, F.col("id") % 50 == 0).collect() == []
    one = spark.createDataFrame([(7, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(one, F.col("id") % 50 == 0).collect() == []


def test_hard_negatives_query(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in table(spark, SMALL, "embeddings").collect()]
    assert Counter(tuple(r) for r in queries.op12_hard_negatives(spark, SMALL).collect()) == plain_mine(rows)


# decontamination


def plain_hits(text, items, window):
    w, hit, found = plain_words(text), set(), set()
    for name, item in items:
        v = plain_words(item)
        m = min(window, len(v))
        for k in range(len(v) - m + 1 if m else 0):
            for at in range(len(w) - m + 1):
                if w[at : at + m] == v[k : k + m]:
                    hit |= set(range(at, at + m))
                    found.add("" if name is None else str(name))
    return len(w), len(hit), sorted(found), sorted(hit)


def check_hits(spark, docs, items, window, **how):
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, n_hit int")
    want = Counter()
    for r in docs.collect():
        n, n_hit, found, hit = plain_hits(r.text, items, window)
        want[r.doc_id, n, n_hit, tuple(found), tuple(hit)] += 1
    got = Counter()
    for r in decontamination.hits(docs, bench, window, **how).collect():
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
        got[r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple(k for s in r.spans for k in range(s.start, s.end))] += 1
    assert got == want


ITEMS = [(1, "a b c d e f"), (2, "A, b! C d"), (2, "x y z"), (3, "b c"), (4, None), (5, " . "), (None, "q r s t"), (10, "w1 the w2 the w3"), (11, "a a a a a a"), (12, "é1 ünï")]


def drawn_texts(spark):
    draw = random.Random(8)
    rows = [(k, " ".join(draw.choice("a a b c d e f x y z q r s t A-B c.d".split()) for _ in range(draw.randint(0, 60)))) for k in range(60)]
    rows += [(1, "a b c d e f" * 3), (100, "a b c d e f x y z q r s t"), (100, "a b c d e f x y z q r s t"), (101, "é1 ÜNÏ ünï"), (102, "a" + " a" * 300)]
    return spark.createDataFrame(rows, "doc_id long, text string").unionByName(text_rows(spark).select("doc_id", "text").where("length(text) < 1000 or text is null"))


@pytest.mark.parametrize("window", [1, 2, 3, 4, 10])
@pytest.mark.parametrize("shard", [20, 1 << 19])
def test_hits_against_plain(spark, window, shard):
    check_hits(spark, drawn_texts(spark), ITEMS, window, shard=shard)


def test_hits_in_many_blocks_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 9)
    long = " ".join(random.Random(2).choice("abcdefxyz") for _ in range(200))
    docs = drawn_texts(spark).unionByName(spark.createDataFrame([(200, f"x {long[40:200]} q"), (201, long)], "doc_id long, text string"))
    check_hits(spark, docs, [*ITEMS, (20, long)], 3, block_words=40)


def test_one_word_items_and_empty_tables(spark):
    docs = text_rows(spark).select("doc_id", "text")
    check_hits(spark, docs, [(1, "five"), (2, "w1 the")], 10)
    check_hits(spark, docs, [(1, None)], 10)
    check_hits(spark, docs.limit(0), ITEMS, 10)


def test_drop_contaminated_and_longest_matches(spark):
    docs = text_rows(spark).unionByName(spark.createDataFrame([(50, "z a b c d e y", 1, 0.5, [2], 7, "q"), (51, "a b c d", 1, 0.5, [2], 7, "q")], text_rows(spark).schema))
    bench = spark.createDataFrame([(1, "a b c d e f"), (2, "one two three")], "item_id long, text string")
    kept = decontamination.drop_contaminated(docs, bench, 4)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect() if r.doc_id not in (3, -9, 50, 51))
    assert sorted(tuple(r) for r in decontamination.longest_matches(docs, bench, 4).collect()) == [("1", 5, 50, 1), ("2", 3, -9, 0)]


def test_decontamination_query(spark):
    docs, items = table(spark, SMALL, "documents").collect(), [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    some = [(n, set(zip(*[plain_words(t)[k:] for k in range(10)], strict=False))) for n, t in items]
    said = {r.doc_id: r for r in queries.op13_decontamination(spark, SMALL).collect()}
    for r in docs:
        w = plain_words(r.text)
        own = set(zip(*[w[k:] for k in range(10)], strict=False))
        names = sorted(str(n) for n, s in some if own & s)
        hit = {k + j for k in range(len(w) - 9) for j in range(10) if any(tuple(w[k : k + 10]) in s for _, s in some)}
        got = said[r.doc_id]
        assert (got.n_words, got.n_hit, got.n_items, got.contaminated) == (len(w), len(hit), len(names), bool(hit))
        assert got.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()


# helpers


def test_slices_hold_few_bytes():
    batch = pa.RecordBatch.from_pylist([{"k": k, "text": None if k == 3 else "x" * n} for k, n in enumerate([5, 0, 100, 0, 40, 40, 40, 3])])
    for rows, size in ((512, 80), (2, 1000), (512, 1)):
        parts = list(sliced([batch], rows, size))
        assert [r["k"] for p in parts for r in p.to_pylist()] == list(range(8))
        assert all(p.num_rows <= rows and (p.num_rows == 1 or sum(len(r["text"] or "") for r in p.to_pylist()) <= size) for p in parts)


def test_tables_of_a_scope_go(spark):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = lambda: {str(f.getPath().getName()) for f in files.listStatus(folder) if f.getPath().getName().startswith("table-")}
    before = names()
    with scratch(spark):
        queries.op3_url_filter(spark, SMALL).count()
        queries.op11_importance_resampling(spark, SMALL).count()
        queries.op4_mix_sources(spark, SMALL).count()
        assert names() > before
    assert names() == before
    one = durable(spark.range(3))
    assert len(names()) == len(before) + 1 and one.count() == 3
    release(one)
    assert names() == before
