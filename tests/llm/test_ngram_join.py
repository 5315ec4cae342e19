import random
import re
from itertools import combinations

import numpy as np
import pytest

from quarry.llm import ngram_join as J


def brute(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = root(i)
        least[r] = min([x for x in (least.get(r), k) if x is not None], default=None)
    return sorted((k, len(s), least[root(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets)))


def corpus():
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, k = [], 1000
    passage = [draw.choice(vocabulary) for _ in range(60)]
    for size, copies, rate in ((150, 260, 0.02), (150, 60, 0.05), (40, 30, 0.02), (700, 12, 0.01), (9, 12, 0.05)):
        base = [draw.choice(vocabulary) for _ in range(size)]
        for _ in range(copies):
            words = [draw.choice(vocabulary) if draw.random() < rate else w for w in base]
            words = words[: draw.randint(int(size * 0.9), size)]
            rows.append(" ".join(words))
    for _ in range(150):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(1, 120))]
        rows.append(" ".join(words + passage * draw.randint(0, 1)))
    rows += ["one two", "ONE\ttwo", "one two three", "", " \n", None, "x", rows[3].upper(), rows[3], rows[3]]
    draw.shuffle(rows)
    return [(k := k - 1, t) for t in rows]


def test_against_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(k, t, "a", 1) for k, t in rows], "doc_id long, text string, node string, class int").repartition(5)
    got = J.near_duplicates(df).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    one = J.keep_one_each(df)
    assert one.columns == df.columns
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, _, c in brute(rows)})


def test_empty_null_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert J.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, None), (8, "")]
    got = sorted((tuple(r) for r in J.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (7, 0, 7), (8, 0, 8)], key=repr)


def test_one_row_of_each_class_stays(spark):
    t, u, v = "a b c d e f g h", "k l m n o p q r", "s t u v w x y z"
    rows = [(5, t, "x"), (5, t, "x"), (5, t, "y"), (None, t, "x"), (None, u, "x"), (None, u, None), (7, v, "x"), (7, v.upper(), "x"), (9, v, "x"), (None, "", "x"), (None, None, "x"), (8, " ", "x"), (8, " ", "x"), (11, "one two", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _one string")
    got = J.keep_one_each(df)
    assert got.columns == df.columns
    got = [tuple(r) for r in got.collect()]
    assert set(got) <= set(rows)
    want = [(5, "a"), (None, "k"), (7, "s"), (None, ""), (None, ""), (8, ""), (8, ""), (11, "o")]
    assert sorted(((k, (x or "").strip().lower()[:1]) for k, x, _ in got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_tree_finds_what_pairs_find(seed):
    draw = np.random.default_rng(seed)
    base = np.unique(draw.integers(0, 10_000, 80))
    sets = [np.unique(np.concatenate([draw.choice(base, draw.integers(50, len(base)), replace=False), draw.integers(0, 10_000, draw.integers(0, 15))])) for _ in range(60)]
    tree = J.Tree(np.zeros(0, np.int64))
    for i, s in enumerate(sets):
        tree.add(s, i)
    for s in sets[:20]:
        want = [i for i, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 75 * len(np.union1d(s, t))]
        assert sorted(tree.linked(s, 75)) == want


@pytest.mark.parametrize("percent", [75, 50, 90])
def test_enough_is_the_least_need_of_all_sizes(spark, percent):
    def need(a, b):  # in whole numbers
        return max(1, J.least_overlap(a, b, percent) - max(-(-percent * k // 100) - 1 for k in (a, b)))

    rows, want = [], {}
    for n in (1, 2, 5, 9, 20, 33, 60, 100, 150):
        like = [m for m in range(1, 2 * n + 3) if percent * n <= 100 * m and percent * m <= 100 * n]
        for low in range(max(1, like[0] - 2), like[-1] + 3, 1 if n < 60 else 4):
            for high in range(low, like[-1] + 3):
                least = min((need(n, m) for m in like if low <= m <= high), default=None)
                want[n, low, high] = least
                rows += [(n, low, high, k) for k in ([least - 1, least] if least else [10 * n])]
    assert percent != 75 or (100, 76, 132, 1) in J.enough(spark.createDataFrame([(100, 76, 132, 1)], "n long, low long, high long, shared long"), 75).collect()
    got = J.enough(spark.createDataFrame(rows, "n long, low long, high long, shared long"), percent).collect()
    assert sorted(map(tuple, got)) == sorted((*k, least) for k, least in want.items() if least)


def test_no_link_is_lost_to_sets_of_other_sizes(spark):
    """Pairs that just link, with two more documents that share a shingle with one of them and widen the range of sizes around it."""
    fresh, rows, pairs = iter(range(10**6)), [], []
    words = lambda k: [f"w{next(fresh)}" for _ in range(k)]
    for n, b, low, high in [(19, 23, 22, 24), (21, 23, 22, 24), (24, 27, 25, 28), (27, 31, 29, 32)] * 40:
        o = -(-75 * (n + b) // 175)
        both = words(o + 4)
        x, y = words(n - o) + both, words(b - o) + both
        more = [y[:5] + words(k - 1) for k in (low, high)]
        at = len(rows)
        rows += [(at + k, " ".join(t)) for k, t in enumerate([x, y, *more])]
        pairs.append(at)
    got = {r.doc_id: r.component_id for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == got[k + 1] == k for k in pairs)
    assert all(got[k + 2] == k + 2 and got[k + 3] == k + 3 for k in pairs)


def test_a_giant_class_and_many_copies(spark):
    """A third of all rows are one text, a third near copies of another one, over several keys, blocks and turns."""
    draw = random.Random(9)
    vocabulary = [f"v{i}" for i in range(500)]
    base = [draw.choice(vocabulary) for _ in range(120)]
    near = []
    for k in range(400):
        t = list(base)
        t[draw.randrange(len(t))] = f"x{k}"
        near.append(" ".join(t))
    rows = near + [" ".join(base[:80])] * 400 + [" ".join(draw.choice(vocabulary) for _ in range(60)) for _ in range(300)]
    got = J.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    label = {r.doc_id: r.component_id for r in got}
    assert {label[k] for k in range(400)} == {0} and {label[k] for k in range(400, 800)} == {400} and all(label[k] == k for k in range(800, 1100))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99)], "a long, b long")
    assert {(r["id"], r["class"]) for r in J.components(edges).collect()} == {(i, 0) for i in range(41)} | {(99, 99), (100, 99)}


def test_forest_keeps_components():
    draw = random.Random(2)
    a, b = ([draw.randrange(60) for _ in range(400)] for _ in range(2))
    x, y = J.forest(a, b)
    assert len(x) < 60 and set(zip(x, y)) <= set(zip(a, b))

    def parts(edges):
        up = {i: i for i in range(60)}
        for _ in range(60):
            for i, j in edges:
                up[i] = up[j] = min(up[i], up[j])
        return up

    assert parts(list(zip(x, y))) == parts(list(zip(a, b)))
    assert J.forest([], []) == ([], [])
