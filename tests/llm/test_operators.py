"""The other operators: against plain versions, the libraries, SQL, exact round trips or held-out labels; then odd inputs."""

import glob
import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quarry.llm import langid, media, mixing, outliers, packing, quality_nbsvm, queries, token_counts, toxicity, url_filter
from quarry.llm.common import fold, table

SMALL, LARGER, LARGEST = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, source string, n int, node long, score double, _size long, _one long, label int"


def odd_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows, extra columns with clashing names."""
    long = " ".join(f"w{i % 977} the" for i in range(60_000))
    rows = [(1, "", "en", "a"), (2, None, "en", "a"), (3, "one two three", None, None), (3, "one two three", None, None), (None, "four  five\n", "en", "b"), (5, long, "de", "b"), (6, " \t\n", None, "c"), (7, "x" * 70_000, "en", None), (8, "<|endoftext|> <pad> é\U0001f600퟿", "fr", "a")]
    return spark.createDataFrame([(*r, 1, 2, 0.5, 7, 3, None) for r in rows], SCHEMA)


def tok():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def texts_of(spark, folder):
    return {r.doc_id: r.text for r in table(spark, folder, "documents").select("doc_id", "text").collect()}


def packs(rows, texts, size=2048):
    """Checks a packing of whole texts; how many sequences it has."""
    t, want = tok(), Counter()
    for doc, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), size):
            part = ids[k : k + size]
            want[doc, k // size, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def test_packing_covers_all_tokens(spark):
    rows = queries.op1_best_fit_packing(spark, SMALL).collect()
    used = packs(rows, list(texts_of(spark, SMALL).items()))
    assert used <= -(-sum(r.length for r in rows) // 2048) + 1


def test_packing_in_many_shards(spark):
    docs = table(spark, SMALL, "documents")
    rows = packing.pack(docs, queries.vocabulary(), shard_rows=40).collect()
    packs(rows, list(texts_of(spark, SMALL).items()))


@pytest.mark.parametrize("seed", range(8))
def test_search_never_needs_more_bins(seed):
    draw = random.Random(seed)
    lengths = [draw.randint(1, 70 if seed % 2 else 40) for _ in range(120)]
    start = packing.best_fit(lengths, 100)
    bins = packing.improved(lengths, start, 100)
    assert sorted(i for b in bins for i in b) == list(range(120))
    assert all(sum(lengths[i] for i in b) <= 100 for b in bins)
    assert -(-sum(lengths) // 100) <= len(bins) <= len(start)


def test_search_saves_a_bin():
    lengths = [44, 44, 44, 28, 28, 28, 28, 28, 28]  # best fit decreasing: 44+44, 44+28+28, 28+28+28, 28
    start = packing.best_fit(lengths, 100)
    assert (len(start), len(packing.improved(lengths, start, 100))) == (4, 3)


def held_out(spark, query, key, label, folder):
    said = {r.doc_id: r for r in query(spark, folder).collect()}
    known = table(spark, folder, label[0]).where(f"{label[1]} is not null").collect()
    test = [(said[r.doc_id], r[label[1]]) for r in known if said[r.doc_id].held_out]
    assert {r.doc_id for r in said.values() if r.held_out} == {k for k in said if zlib.crc32(str(k).encode()) % key[0] == key[1]}
    return test, said


def ranked_right(test):
    """Share of pairs of a label 1 and a label 0 that the score puts in order."""
    one, zero = ([r.score for r, y in test if y == k] for k in (1, 0))
    return sum((a > b) + (a == b) / 2 for a in one for b in zero) / (len(one) * len(zero))


def test_quality_held_out(spark):
    test, said = held_out(spark, queries.op2_quality_classifier, (5, 0), ("labels", "quality"), LARGEST)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in said.values())
    assert ranked_right(test) > 0.9
    assert sum(r.predicted == y for r, y in test) / len(test) > 0.85


def test_toxicity_held_out(spark):
    test, said = held_out(spark, queries.op8_toxicity, (4, 2), ("labels", "toxic"), LARGEST)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in said.values())
    assert ranked_right(test) > 0.93  # of 329 toxic texts to learn from
    assert sum(r.predicted == y for r, y in test) / len(test) > 0.9


def test_language_held_out(spark):
    test, said = held_out(spark, queries.op5_language_id, (5, 0), ("documents", "lang"), LARGER)
    learned = {r.lang_pred for r in said.values()}
    assert learned <= {y for _, y in test} | {"und"}
    assert sum(r.lang_pred == y for r, y in test if r.lang_pred != "und") / max(1, sum(r.lang_pred != "und" for r, _ in test)) > 0.9


@pytest.mark.parametrize("chunk", [1, 2, 5, 1 << 18])
def test_n_grams_of_a_text(chunk):
    codes, counts = langid.grams("ab ab", chunk)
    spelled = {"".join("" if not (x := c >> (21 * k) & 0x1FFFFF) else chr(x) for k in (2, 1, 0)): int(n) for c, n in zip(codes, counts)}
    assert spelled == {"a": 2, "b": 2, "_a": 2, "ab": 2, "b_": 2, "_ab": 2, "ab_": 2, "b_a": 1}


def test_gradients_are_those_of_the_loss():
    draw = np.random.default_rng(1)
    sample = [(" ".join(draw.choice(["bad", "nice", "day", "tree", "sun"], 12)) + (" bad awful" if k else ""), k) for k in (0, 1) * 20]
    net = toxicity.train(sample, 0.5, epochs=1)
    net.p = {k: np.asarray(v, np.float64) for k, v in net.p.items()}
    ((names, index, _),) = toxicity.indexed([t for t, _ in sample[:6]])
    ix = index.T
    x, mask, y = net.inputs(names)[ix].astype(float), (ix > 0).astype(float)[..., None], np.array([0, 1] * 3, float)

    def loss():
        h = np.concatenate([net.scan(x @ net.p[f"w{s}"] + net.p[f"b{s}"], mask, s) for s in "fb"], axis=2)
        z = net.pooled(h, mask)[2] @ net.p["w"] + net.p["b"]
        return float(np.mean(np.logaddexp(0, z) - y * z))

    grad = toxicity.gradients(net, x, mask, y)
    for k in net.p:
        some = np.unravel_index(int(np.abs(grad[k]).argmax()), np.shape(grad[k]))
        ends = []
        for d in (1e-2, -1e-2):
            kept = net.p[k].copy()
            net.p[k] = kept.copy()
            net.p[k][some] += d
            ends.append(loss())
            net.p[k] = kept
        assert (ends[0] - ends[1]) / 2e-2 == pytest.approx(float(grad[k][some]), rel=0.05, abs=1e-4)
    some, ends = np.unravel_index(int(np.abs(grad["x"]).argmax()), x.shape), []
    for d in (1e-2, -1e-2):
        x[some] += d
        ends.append(loss())
        x[some] -= d
    assert (ends[0] - ends[1]) / 2e-2 == pytest.approx(float(grad["x"][some]), rel=0.05, abs=1e-4)


def plain_highest(net, text):
    """The score of a text's highest window, one word and one window at a time."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    rows = []
    for w in (x.strip(toxicity.AROUND) for x in (text or "").encode().lower().split()):
        if w:
            grams = [(b"<" + w + b">")[i : i + 3] for i in range(len(w))]
            code = [((g[0] << 16 | g[1] << 8 | g[2]) * 2654435761 & 0xFFFFFFFF) >> (32 - toxicity.CHAR_BITS) for g in grams]
            rows.append(np.concatenate([net.word[zlib.crc32(w) & ((1 << toxicity.WORD_BITS) - 1)], np.mean([net.char[c] for c in code], axis=0)]).astype(float))
    best, at = -np.inf, 0
    while True:
        part, states = rows[at : at + toxicity.WIDTH], {}
        for s in "fb":
            h, out = np.zeros(toxicity.HIDDEN), []
            for v in part if s == "f" else part[::-1]:
                g, u = v @ net.p[f"w{s}"] + net.p[f"b{s}"], h @ net.p[f"u{s}"]
                k = toxicity.HIDDEN
                z, r = sig(g[:k] + u[:k]), sig(g[k : 2 * k] + u[k : 2 * k])
                n = np.tanh(g[2 * k :] + r * u[2 * k :])
                h = (1 - z) * n + z * h
                out.append(h)
            states[s] = out if s == "f" else out[::-1]
        h = [np.concatenate(x) for x in zip(states["f"], states["b"])]
        e = np.array([np.tanh(x @ net.p["wa"] + net.p["ba"]) @ net.p["va"] for x in h])
        a = np.exp(e - e.max()) if len(e) else e
        pool = sum((x * y for x, y in zip(a / a.sum(), h)), np.zeros(2 * toxicity.HIDDEN)) if len(e) else np.zeros(2 * toxicity.HIDDEN)
        best = max(best, float(pool @ net.p["w"] + net.p["b"]))
        at += toxicity.STRIDE
        if at + toxicity.WIDTH - toxicity.STRIDE >= len(rows):
            return best


def test_scores_are_those_of_the_highest_window():
    draw = np.random.default_rng(1)
    sample = [(" ".join(draw.choice(["bad", "nice", "day", "tree", "sun"], 30)) + (" bad awful" if k else ""), k) for k in (0, 1) * 20]
    net = toxicity.train(sample, 0.5, epochs=1, least_steps=1)
    texts = ["", None, " ... ", "Awful!", *(" ".join(draw.choice(["bad", "Nice,", "day.", "tree", "--", "awful", "x\ny"], n)) for n in (3, 39, 40, 41, 59, 60, 61, 100, 101, 700))]
    want = [plain_highest(net, t) for t in texts]
    assert net.highest(texts).tolist() == pytest.approx(want, abs=1e-3)
    for most in (30, 211, 1000):  # long texts in parts have the windows of the whole text
        groups = list(toxicity.indexed(texts, most))
        flat = lambda groups: sorted((int(k), tuple(([b""] + names)[i] for i in row)) for names, index, of in groups for k, row in zip(of, index))
        assert flat(groups) == flat(toxicity.indexed(texts, 1 << 62)) and (most > 300 or len(groups) > 2)


def test_dual_descent_is_at_the_optimum():
    """The duality gap of the hinge-loss model is closed."""
    draw = np.random.default_rng(4)
    y = np.where(np.arange(60) % 3 == 0, 1.0, -1.0)
    rows = [np.unique(np.concatenate([draw.integers(0, 40, 8), draw.integers(20 if k > 0 else 0, 40 if k > 0 else 20, 2)])) for k in y]
    values = quality_nbsvm.log_count_ratios(rows, y)[: 1 << quality_nbsvm.BITS]
    w, bias, alpha = quality_nbsvm.dual_descent(rows, values, y, cost=0.5, epochs=3000)
    x = np.zeros((60, len(values)))
    for i, r in enumerate(rows):
        x[i, r] = values[r] / np.sqrt((values[r] ** 2).sum())
    assert w == pytest.approx(x.T @ (alpha * y), abs=1e-9) and bias == pytest.approx((alpha * y).sum()) and alpha.min() >= 0 and alpha.max() <= 0.5
    square = (w @ w + bias * bias) / 2
    primal = square + 0.5 * np.maximum(0, 1 - y * (x @ w + bias)).sum()
    assert primal - (alpha.sum() - square) < 1e-3 * primal


@pytest.mark.parametrize("size", [3, 1000])
def test_parts_of_quality_features(monkeypatch, size):
    text = "The cat, the cat!! " * 30 + "SAT | on\nSAT | on\n" * 5 + "\u00e9t\u00e9 1234"
    whole = sorted(quality_nbsvm.features(text).tolist())
    assert len(set(whole)) == len(whole)
    monkeypatch.setattr(quality_nbsvm, "PART", size)
    assert sorted(quality_nbsvm.features(text).tolist()) == whole
    texts = ["", None, "the cat", text, "the", " ", text * 2, "cat the cat the cat"]
    for most in (1, 500, 1 << 20):
        assert [x.tolist() for x in quality_nbsvm.features_of(texts, most)] == [quality_nbsvm.features(t).tolist() for t in texts]
    words = text.encode().lower().split()
    assert quality_nbsvm.shapes(b"Aaa BB12,, cc\n") == b"Aa A0, a\n"
    assert quality_nbsvm.seen_before(quality_nbsvm.word_hashes(text.lower().encode())[0]).tolist() == [w in words[:i] for i, w in enumerate(words)]


def test_profiles_and_distances_against_plain_ones(spark):
    """Profiles from counts of all n-grams, and the language of the least sum of rank differences."""
    docs = table(spark, SMALL, "documents")
    held = fold("doc_id", 5) == 0
    rows = docs.select("doc_id", "text", "lang", held.alias("held")).collect()

    def counted(texts):
        out = Counter()
        for t in texts:
            t = re.sub("_+", "_", "".join(c if c.isalpha() else "_" for c in f" {t.lower()} "))
            out.update(g for n in (1, 2, 3) for i in range(len(t) - n + 1) if (g := t[i : i + n]) != "_")
        return out

    def first(counts, size):
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], sum(ord(c) << (21 * k) for k, c in enumerate(reversed(x[0])))))][:size]

    size = 150
    texts = defaultdict(set)
    for r in rows:
        if r.lang is not None and r.text is not None and not r.held:
            texts[r.lang].add(r.text)
    profiles = {k: first(counted(v), size) for k, v in texts.items()}
    got = langid.learn_profiles(docs, ~held, size)
    spelled = lambda c: "".join(chr(x) for k in (2, 1, 0) if (x := c >> (21 * k) & 0x1FFFFF))
    assert {k: [spelled(c) for c in v] for k, v in got.items()} == profiles
    said = {r.doc_id: r for r in langid.identify(docs, got, size).collect()}
    for r in rows[:60]:
        if r.text and any(c.isalpha() for c in r.text):
            top = first(counted([r.text]), size)
            away = {k: sum(abs(i - p.index(g)) if g in p else size for i, g in enumerate(top)) for k, p in profiles.items()}
            assert said[r.doc_id].lang_pred == min(sorted(away), key=away.get)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    duck = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        duck.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    df, cursor = queries.QUERIES[name](spark, SMALL), duck.execute(queries.SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[k]) for k in names) for r in df.collect()), key=repr) == want


def test_url_rules_and_list(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://A.Org?x": ("a.org", "", None, "allow"), "http://A.Org/q": ("a.org", "/q", "org/", "allow"),
        "http://example.org/es/x#y": ("example.org", "/es/x", "example.org/es/", "block"), "http://s.example.org/en/17": ("s.example.org", "/en/17", "example.org/en/1", "block"), "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"), "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"), "https://www.x.net/a/": ("www.x.net", "/a/", None, "block"), "https://x.net/b": ("x.net", "/b", None, "allow"),
    }
    pages = spark.createDataFrame([(k, u, 1) for k, u in enumerate([*cases, *cases])], "page_id long, url string, block int")
    listed = spark.createDataFrame([("x.net/a",), ("x.net/a",), (None,)], "k string")
    got = url_filter.judge_urls(pages, listed, queries.RULES).collect()
    want = [*cases.values(), *cases.values()]
    assert len(got) == len(want) and all((r.host, r.path, r.rule, r.verdict) == want[r.page_id] for r in got)
    none = url_filter.judge_urls(pages, listed.limit(0), queries.RULES).collect()
    assert {r.verdict for r in none if r.rule is None} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), listed, queries.RULES).collect() == []


def test_filter_has_no_false_negative(spark):
    pages = spark.range(20_000).selectExpr("id as page_id", "concat('http://h', id % 700, '.net/p', id) as url")
    listed = pages.where("page_id % 3 = 0").selectExpr("substring(url, 8) as k")
    got = url_filter.judge_urls(pages, listed, []).groupBy("listed", (url_filter.F.col("page_id") % 3 == 0).alias("should")).count().collect()
    assert sorted((r.listed, r.should, r["count"]) for r in got) == [(False, False, 13_333), (True, True, 6667)]


def test_water_filling(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, None: 20}
    rows = mixing.water_fill(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), [5, 2, 1], 3).collect()
    weight, left, target = {"a": 5.0, "b": 2.0, "c": 1.0, None: 5.0}, float(sum(sizes.values())), {}
    while True:
        open_ = [k for k in sizes if k not in target]
        over = [k for k in open_ if left * weight[k] / sum(weight[x] for x in open_) > 3 * sizes[k]]
        if not over:
            target |= {k: left * weight[k] / sum(weight[x] for x in open_) for k in open_}
            break
        left -= sum(3 * sizes[k] for k in over)
        target |= {k: 3.0 * sizes[k] for k in over}
    assert {r.source: pytest.approx(r.target) for r in rows} == target


def test_mix_comes_near_its_targets(spark):
    rows = queries.op4_mix_sources(spark, LARGER).collect()
    source = {r.doc_id: r.source for r in table(spark, LARGER, "documents").select("doc_id", "source").collect()}
    taken, target, longest = Counter(), {}, Counter()
    for r in rows:
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        s = source[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        longest[s] = max(longest[s], r.size)
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in target)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op4_mix_sources(spark, LARGER).collect()))


def plain_pairs(samples):
    """Fingerprint by the definition, frame by frame."""
    hop, frame = media.FRAME // 2, media.FRAME
    found = []
    for k in range(max(1, (len(samples) - frame) // hop + 1)):
        power = np.abs(np.fft.rfft((samples[k * hop : k * hop + frame].astype(np.float32) - 128) * np.hanning(frame).astype(np.float32))).astype(np.float32)
        tops = [(-round(float(power[f]), 2), f) for f in range(1, len(power) - 1) if power[f] > power[f - 1] and power[f] >= power[f + 1] and power[f] > 1e-3]
        found.append([f for _, f in sorted(tops)[: media.PEAKS]])
    return sorted((t, a << 16 | b << 8 | d) for d in range(1, media.FAN + 1) for t in range(len(found) - d) for a in found[t] for b in found[t + d])


def test_media_round_trip(spark):
    docs = odd_rows(spark)
    got = media.media_features(docs, keep_media=True).collect()
    texts = docs.collect()
    by_id = {r.doc_id: (r.text or "").encode() for r in texts}
    assert len(got) == len(texts)
    for r in got:
        raw = by_id[r.doc_id]
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert media.from_wav(bytes(r.media)) == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256, r.n_peak_pairs) == (len(r.media), hashlib.sha256(r.media).hexdigest(), len(r.times))
    text = next(t for t in texts_of(spark, SMALL).values() if t and 2000 < len(t) < 4000).encode()
    samples = np.frombuffer(text[: len(text) // 192 * 192], np.uint8)
    assert list(zip(*map(np.ndarray.tolist, media.fingerprint(samples)))) == plain_pairs(samples)


def test_token_counts_are_the_library_s(spark):
    t, texts = tok(), texts_of(spark, SMALL)
    got = queries.op9_token_counts(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 2048)


@pytest.mark.parametrize("text", ["<|endoftext|> Hello World", "Hello <| World", "x<|y Hello, WORLD. <|endoftext|>", "<|ENDOFTEXT|> \u00c9T\u00c9 \u00c9t\u00e9!", "<| A hELLo hello"])
def test_capitals_beside_special_strings(text):
    enc = token_counts.Encoder(queries.vocabulary())
    assert enc.fast is not None
    assert np.frombuffer(enc.packed(text), "<u4").tolist() == tok().encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("chunk", "overlap"), [(400, 8), (1000, 64), (150, 140)])
def test_splices_of_chunks(spark, chunk, overlap):
    t, enc = tok(), token_counts.encoder(queries.vocabulary())
    texts = [x for x in texts_of(spark, SMALL).values() if x and len(x) > 1500][:25]
    for x in [*texts, "a" * 3000, "x" * 1200 + " y " + "z" * 1200, "中文" * 900, "<|endoftext|>" * 200 + " b" * 300]:
        assert sum(token_counts.resynced(enc, x, chunk, overlap)) == len(t.encode(x, add_special_tokens=False).ids)


def plain_stats(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    again = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def test_quality_rules_base(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text", "lang", "source").unionByName(odd_rows(spark).select("doc_id", "text", "lang", "source").withColumn("doc_id", outliers.F.col("doc_id") - 1000))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in outliers.quality_rules(docs).collect():
        s = plain_stats(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == s
        assert r.base_failed == (s[0] < 50 or 100 * s[4] > 50 * s[0])
        assert not (r.kept and r.base_failed) and r.kept is not None


def test_outliers_go_and_the_rest_stays(spark):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 9)))
    rows = [(k, " ".join(word() for _ in range(draw.randint(60, 200))), "en", "a" if k % 3 else None) for k in range(400)]
    rows += [(1000 + k, " ".join(word() + "#$%|<>" for _ in range(120)), "en", "a") for k in range(20)]
    rows += [(2000, " ".join(word() * 12 for _ in range(100)), "xx", "few")]  # of a group too small for its own estimate
    kept = {r.doc_id: r.kept for r in outliers.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(v for k, v in kept.items() if k >= 1000)
    assert sum(v for k, v in kept.items() if k < 1000) >= 396


def plain_mcd(x, part, starts, seed=0):
    """The least log determinant over random elemental starts, each with concentration steps to the end; where it was found."""
    floor, low = np.diag(np.square(outliers.FLOORS)), lambda v, q: np.sort(v)[int(np.ceil(q * len(v))) - 1]
    draw, best = np.random.default_rng(seed), (np.inf, None)
    for _ in range(starts):
        some = x[draw.choice(len(x), 6, replace=False)]
        centre, cov, was = some.mean(axis=0), np.cov(some.T, bias=True), np.inf
        while True:
            d = np.einsum("ni,ij,nj->n", x - centre, np.linalg.inv(cov + floor), x - centre)
            near = x[d <= low(d, part)]
            centre, cov = near.mean(axis=0), np.cov(near.T, bias=True)
            now = np.linalg.slogdet(cov + floor)[1]
            if now > was - outliers.TOLERANCE:
                break
            was = now
        best = min(best, (was, centre.tolist()))
    return best


def scattered(kind):
    draw = np.random.default_rng(3)
    x = draw.standard_normal((501, 4)) @ np.array([[1, 0.4, 0, 0], [0, 1, 0.2, 0], [0, 0, 1.5, 0.3], [0, 0, 0, 0.7]])
    if kind == "outliers":
        x[:50] += 9
    elif kind == "clusters":  # a tight majority away from the middle of all
        x[:376] = x[:376] * 0.3 + np.array([4, 0, 0, 0])
        x[376:] = x[376:] * 2.5 - np.array([5, 5, 0, 0])
    return x


@pytest.mark.parametrize("kind", ["plain", "outliers", "clusters"])
def test_least_determinant_against_numpy(spark, kind):
    x = scattered(kind)
    df = spark.createDataFrame([("a", *map(float, r)) for r in x] + [("b", *map(float, r)) for r in x[::-1]], "g string, x0 double, x1 double, x2 double, x3 double")
    want, centre = plain_mcd(x, 0.75, 60)
    got = {r.g: r for r in outliers.estimates(df, "g", 0.75).collect()}
    for r in got.values():
        assert r.log_det <= want + 0.03
        lower = np.array([[r._m[f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        assert 2 * np.log(np.diag(lower)).sum() == pytest.approx(r.log_det)
    if kind == "outliers":
        m = got["a"]._m
        lower = np.array([[m[f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        y = np.linalg.solve(lower, (x - np.array([m[f"m{i}"] for i in range(4)])).T)
        assert (y[:, :50] ** 2).sum(axis=0).min() / got["a"]._scale > outliers.CUT_4 and np.abs([m[f"m{i}"] for i in range(4)]).max() < 0.5


def test_one_start_may_end_at_the_wrong_place(spark):
    """A third of the texts far off draws the mean along; the least determinant is found from other starts."""
    draw = np.random.default_rng(5)
    x = np.concatenate([draw.standard_normal((300, 4)), draw.standard_normal((100, 4)) * 0.2 + np.array([12, 0, 0, 0]), draw.standard_normal((100, 4)) * 0.2 + np.array([-12, 12, 0, 0])])
    df = spark.createDataFrame([("a", *map(float, r)) for r in x], "g string, x0 double, x1 double, x2 double, x3 double")
    each = {s: outliers.estimates(df, "g", 0.6, [s]).first().log_det for s in ("mean", "median", "signs", "near half", "drawn 0", "drawn 1", "drawn 2", "drawn 3")}
    every = outliers.estimates(df, "g", 0.6).first().log_det
    assert max(each.values()) > every + 0.5 and every <= min(each.values()) + 0.01


def test_odd_inputs(spark):
    docs = odd_rows(spark)
    none, n = docs.limit(0), docs.count()
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (5, None, 1), (None, 1, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        for learn, score in ((quality_nbsvm.learn_quality, quality_nbsvm.score_quality), (toxicity.learn_toxicity, toxicity.score_toxicity)):
            model = learn(docs, some, fold("doc_id", 5) != 99)
            rows = score(docs, model).collect()
            assert len(rows) == n and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id == 3}) == 1
            assert score(none, model).collect() == []
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() in (0, n)
    assert quality_nbsvm.keep_good(docs, quality_nbsvm.constant(0.9)).collect() == docs.collect()
    profiles = langid.learn_profiles(docs, fold("doc_id", 5) != 99)
    said = {r.doc_id: r for r in langid.identify(docs, profiles).collect()}
    assert (said[1].lang_pred, said[2].lang_pred, said[6].lang_pred) == ("und",) * 3 and said[3].lang_pred in ("en", "de", "fr")
    assert langid.identify(none, profiles).collect() == []
    assert {r.lang_pred for r in langid.identify(docs, langid.learn_profiles(none, fold("doc_id", 5) != 99)).collect()} == {"und"}
    t = tok()
    assert sorted((r.n_tokens for r in token_counts.count_tokens(docs, queries.vocabulary()).collect())) == sorted(len(t.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect())
    packs(packing.pack(docs, queries.vocabulary()).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    plan = mixing.mix_plan(docs, [5, 2, 1]).collect()
    assert len(plan) == n and all(r.taken == 0 for r in plan if r.size == 0)
    mix = mixing.mixed(docs, [5, 2, 1])
    assert mix.columns == docs.columns and set(mix.collect()) <= set(docs.collect())
    for empty in (media.media_features(none), token_counts.count_tokens(none, queries.vocabulary()), packing.pack(none, queries.vocabulary()), mixing.mix_plan(none, [5, 2, 1]), mixing.mixed(none, [1]), outliers.quality_rules(none)):
        assert empty.collect() == []


def test_a_very_long_text(spark):
    """Three million characters in one row: whole counts and scores, equal to those of plain versions where these are quick."""
    draw = random.Random(6)
    words = [draw.choice(["tree", "Sun", "day,", "the", "rain"]) + str(draw.randrange(3000)) for _ in range(400_000)]
    words[399_990] = "awful"
    text = " ".join(words)
    docs = spark.createDataFrame([(1, text, "en", "a"), (2, "the sun", "en", "a")], "doc_id long, text string, lang string, source string")
    r = outliers.base_stats(docs).where("doc_id = 1").first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_stats(text)
    sample = [(" ".join(draw.choice(["tree1", "sun2", "day3"]) for _ in range(20)) + (" awful" if k else ""), k) for k in (0, 1) * 30]
    net = toxicity.train(sample, 0.5, epochs=4, least_steps=60)
    some = toxicity.score_toxicity(docs, net).where("doc_id = 1").first().score
    groups = list(toxicity.indexed([text]))
    assert sum(len(i) for _, i, _ in groups) == len(toxicity.windows(400_000)) and len(groups) > 2 and some == pytest.approx(float(net.scores([text])[0]))
    model = quality_nbsvm.fit(sample, 0.5)
    assert quality_nbsvm.score_quality(docs, model).where("doc_id = 1").first().score == pytest.approx(float(model.scores([text])[0]))
    profiles = langid.learn_profiles(docs, fold("doc_id", 5) != 99)
    assert {r.lang_pred for r in langid.identify(docs, profiles).collect()} == {"en"}
