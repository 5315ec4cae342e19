"""Quality classifier: Naive Bayes support vectors.

A text's features are indicators of hashed n-grams of four sequences: its bytes (3), its words (1 and 2,
A-Z lower-cased), the shapes of its words (1 to 4: runs of small letters, capitals and digits as one sign each,
all else as it stands, and whether the word repeats the one before), and its words and its lines as new or
seen before in the text (8 words, 1 and 3 lines). An indicator is scaled by the log of the ratio of the class
frequencies of its feature, and a linear hinge-loss model is fitted by dual coordinate descent. A logistic
curve fitted to the margins of a part held back turns margins into probabilities at the true share of the classes.

Learned from at most `per_class` labelled texts of each class, of `max_chars` characters in sum;
everything is scored whole, long texts with temporary memory of a few bytes a byte. Null text counts as empty,
and empty text has a score like any other. If one class is missing among the labels, all scores are that class's
share (0.5 if there is no label at all). Repeated rows get equal scores; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import labelled_sample, mapped, sliced
from quarry.llm.ngram_join import runs, word_hashes

BITS, PER_CLASS, MAX_CHARS, PART = 18, 2500, 12_000_000, 1 << 20
#: The sign of each byte in a shape.
SIGNS = np.arange(256, dtype=np.uint8)
for low, high, sign in ((ord("a"), ord("z"), "a"), (ord("A"), ord("Z"), "A"), (ord("0"), ord("9"), "0"), (128, 255, "a")):
    SIGNS[low : high + 1] = ord(sign)


def seen_before(h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    out[np.unique(h, return_index=True)[1]] = False
    return out


def shapes(raw: bytes) -> bytes:
    """The text with runs of equal signs as one sign; white space stays white space."""
    c = SIGNS[np.frombuffer(raw, np.uint8)]
    return c[np.diff(c, prepend=0) != 0].tobytes()


def coded(h: np.ndarray, kind: int) -> np.ndarray:
    """Numbers of features by hashes; kind tells the sequences apart."""
    return ((h.view(np.uint64) ^ np.uint64(kind * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - BITS)).astype(np.int32)


def features_of(texts: list[str | None], most: int = 1 << 22):
    """Of each text the numbers of the features that it has, each once. Texts are read in groups of about `most` bytes."""
    group, size = [], 0
    for text in texts:
        group.append((text or "").encode())
        size += len(group[-1])
        if size >= most:
            yield from group_features(group)
            group, size = [], 0
    yield from group_features(group)


def group_features(raws: list[bytes]):
    whole = b"\n".join(raws)
    word, start = word_hashes(whole.lower())
    shape = word_hashes(shapes(whole))[0]
    first = np.searchsorted(start, np.cumsum([0, *[len(r) + 1 for r in raws]])).tolist()
    again = np.zeros(len(word), bool)
    again[1:] = word[1:] == word[:-1]
    again[[k for k in first if k < len(word)]] = False  # the word before is another text's
    shape = shape * np.uint64(2) + again
    by_words = [(n, coded(runs(word, n), n)) for n in (1, 2)] + [(n, coded(runs(shape, n), 4 + n)) for n in (1, 2, 3, 4)]
    last = np.zeros(1 << BITS, np.int32)
    for raw, a, b in zip(raws, first, first[1:], strict=False):
        codes = [codes[a : max(a, b - n + 1)] for n, codes in by_words]
        for at in range(0, len(raw) - 2, PART):
            c = np.frombuffer(raw, np.uint8, min(PART + 2, len(raw) - at), at).astype(np.uint32)
            codes.append((((c[:-2] << 16 | c[1:-1] << 8 | c[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32))
        codes.append(coded(runs(seen_before(word[a:b]).astype(np.uint64), 8), 9))
        line = np.array([zlib.crc32(x) for x in raw.split(b"\n") if x.strip()], np.uint64)
        codes += [coded(runs(seen_before(line).astype(np.uint64), n), 9 + n) for n in (1, 3)]
        every = np.concatenate(codes)
        places = np.arange(len(every), dtype=np.int32)
        last[every] = places  # of equal numbers the last one stays
        yield every[last[every] == places]


def features(text: str | None) -> np.ndarray:
    return next(features_of([text]))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p, q = np.full(1 << BITS, smooth), np.full(1 << BITS, smooth)
    for x, k in zip(rows, y, strict=True):
        (p if k > 0 else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: float = 0.1, epochs: int = 12, seed: int = 3) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and dual variables of the L1-loss linear support vector machine on rows scaled to length 1."""
    norm = np.array([max(1e-12, np.sqrt((values[x] ** 2).sum())) for x in rows])
    w, bias, alpha = np.zeros(len(values)), 0.0, np.zeros(len(rows))
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in draw.permutation(len(rows)):
            v = values[rows[i]] / norm[i]
            g = y[i] * (w[rows[i]] @ v + bias) - 1
            new = min(max(alpha[i] - g / 2.0, 0.0), cost)  # the row and its bias have squared length 2
            if (d := new - alpha[i]) != 0:
                w[rows[i]] += d * y[i] * v
                bias += d * y[i]
                alpha[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-4 * cost:
            break
    return w, bias, alpha


def logistic_fit(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic curve (Newton's method, slightly smoothed targets)."""
    a, b, t = 1.0, 0.0, np.where(y > 0, 0.998, 0.002)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        r, s = weight * (p - t), weight * p * (1 - p) + 1e-9
        h = np.array([[(s * margin**2).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, [(r * margin).sum() + 1e-3 * a, r.sum()])
        step *= min(1, 2 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


@dataclass
class Model:
    weight: np.ndarray
    value: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, x: np.ndarray) -> float:
        v = self.value[x]
        return float(self.weight[x] @ v / max(1e-12, np.sqrt((v**2).sum())) + self.bias)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        margin = np.array([self.margin(x) for x in features_of(texts)], float)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def constant(share: float) -> Model:
    p = min(max(share, 1e-6), 1 - 1e-6)
    return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0, float(np.log(p / (1 - p))))


def fit(sample: list[tuple[str, int]], share: float) -> Model:
    """share: of class 1 among all labels."""
    y = np.array([1.0 if k else -1.0 for _, k in sample])
    if len(set(y)) < 2:
        return constant(0.5 if not len(y) else float(y[0] > 0))
    rows = list(features_of([t for t, _ in sample]))
    back = np.array([zlib.crc32(t.encode()) % 4 == 0 for t, _ in sample])
    if len(set(y[back])) < 2 or len(set(y[~back])) < 2:
        back[:] = False
    learn = np.flatnonzero(~back)
    some = [rows[i] for i in learn]
    ratio = log_count_ratios(some, y[learn])
    w, bias, _ = dual_descent(some, ratio, y[learn])
    model = Model(w, ratio, bias, 1.0, 0.0)
    test = np.flatnonzero(back) if back.any() else learn
    margin, yt = np.array([model.margin(rows[i]) for i in test]), y[test]
    weight = np.where(yt > 0, share / (yt > 0).sum(), (1 - share) / (yt < 0).sum()) * len(yt)
    model.slope, model.offset = logistic_fit(margin, yt, weight)
    return model


def learn_quality(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    share = labels.where(learn & F.col(label).isin(0, 1)).agg(F.avg(label)).first()[0]
    return fit(labelled_sample(docs, labels, label, learn, per_class, max_chars), 0.5 if share is None else float(share))


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for each row of docs (doc_id, text)."""
    packed = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: 2 ** BITS features

    def run(batches):
        m = packed.value
        for batch in sliced(batches):
            score = m.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least the threshold."""
    packed = docs.sparkSession.sparkContext.broadcast(model)
    at, schema = docs.columns.index("text"), docs.schema

    def run(batches):
        m = packed.value
        for batch in sliced(batches):
            yield batch.filter(pa.array(m.scores(batch.column(at).to_pylist()) >= threshold))

    return mapped(docs, run, schema)
