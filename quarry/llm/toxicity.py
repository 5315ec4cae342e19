"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text's words (lower-cased, without punctuation around them) are read in windows of WIDTH words that
overlap by WIDTH - STRIDE, so every run of that many words and one more lies whole in some window. Each word
enters as two vectors: one of the hashed word and the mean of those of its hashed character trigrams, so unseen
forms of known words count too. Both tables start from small random numbers, with the class log-odds in the
first column, and are trained with the rest. The text's score is that of its highest window.

The network is trained on windows: those of clean texts, and of each toxic text the highest under the
present model. A logistic curve fitted to the highest windows of held-back texts at the true share of the
classes gives probabilities. Learned from at most `per_class` labelled texts of each class, of `max_chars`
characters in sum; everything is scored whole, a long text part by part.

Null text counts as empty: one window without words, with a score like any other. If one class is missing
among the labels, all scores are that class's share (0.5 if there is no label). Repeated rows get equal
scores; other columns of the input are not read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import labelled_sample, mapped, sliced
from quarry.llm.quality_nbsvm import logistic_fit

WORD_BITS, CHAR_BITS, WIDE, HIDDEN, WIDTH, STRIDE, BATCH = 16, 14, 8, 8, 40, 20, 1024
PER_CLASS, MAX_CHARS, PART_CHARS = 1200, 8_000_000, 1_000_000
SPACE = re.compile(r"[ \t\n\x0b\x0c\r]")
AROUND = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(text: str | None) -> list[bytes]:
    return [w for x in (text or "").encode().lower().split() if (w := x.strip(AROUND))]


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all words, each between < and >, and where each word's begin."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    b = np.frombuffer(b"".join([b"<" + w + b">" for w in words]) + b"  ", np.uint8).astype(np.uint32)
    begin = np.concatenate([[0], np.cumsum(size + 2)[:-1]])
    keep = np.ones(len(b) - 2, bool)
    ends = begin + size + 2
    keep[ends - 2] = keep[ends - 1] = False
    code = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - CHAR_BITS)
    return code[keep], np.concatenate([[0], np.cumsum(size)[:-1]])


def windows(n: int) -> np.ndarray:
    """Starts of the windows over n words."""
    return np.arange(0, max(1, n - WIDTH + STRIDE), STRIDE)


@dataclass
class Net:
    word: np.ndarray  # 2 ** WORD_BITS x WIDE
    char: np.ndarray  # 2 ** CHAR_BITS x WIDE
    p: dict[str, np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    offset: float = 0.0

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """A row for each word, after a row of zeros for padding."""
        out = np.zeros((len(words) + 1, 2 * WIDE), np.float32)
        for at in range(0, len(words), 50_000):
            some = words[at : at + 50_000]
            code, begin = trigrams(some)
            out[at + 1 : at + 1 + len(some), :WIDE] = self.word[np.fromiter(map(zlib.crc32, some), np.int64, len(some)) & ((1 << WORD_BITS) - 1)]
            mean = np.add.reduceat(self.char[code], begin, axis=0) / np.diff(np.append(begin, len(code)))[:, None]
            out[at + 1 : at + 1 + len(some), WIDE:] = mean
        return out

    def scan(self, gx: np.ndarray, mask: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """States of one direction; gx: time x batch x 3 HIDDEN, mask: time x batch x 1."""
        u, h = self.p[f"u{side}"], np.zeros((gx.shape[1], HIDDEN), np.float32)
        out = np.empty((*gx.shape[:2], HIDDEN), np.float32)
        for t in range(len(gx)) if side == "f" else range(len(gx) - 1, -1, -1):
            hu, g = h @ u, gx[t]
            zr = 0.5 * np.tanh(0.5 * (g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])) + 0.5
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = (n + z * (h - n)) * mask[t]
            if keep is not None:
                keep.append((t, h, z, r, n, hu[:, 2 * HIDDEN :]))
            out[t] = h = new
        return out

    def pooled(self, h: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u = np.tanh(h @ self.p["wa"] + self.p["ba"])
        e = u @ self.p["va"] + (mask[..., 0] - 1) * 1e4
        a = np.exp(e - e.max(axis=0)) * mask[..., 0]
        a /= a.sum(axis=0) + 1e-9
        return u, a, (a[..., None] * h).sum(axis=0)

    def logits(self, table: dict[str, np.ndarray], index: np.ndarray) -> np.ndarray:
        """index: windows x WIDTH, rows of the tables of gate inputs of the two directions; 0 pads."""
        out = np.empty(len(index), np.float32)
        for at in range(0, len(index), BATCH):
            ix = np.ascontiguousarray(index[at : at + BATCH].T)
            mask = (ix > 0).astype(np.float32)[..., None]
            h = np.concatenate([self.scan(table[s][ix], mask, s) for s in "fb"], axis=2)
            out[at : at + BATCH] = self.pooled(h, mask)[2] @ self.p["w"] + self.p["b"]
        return out

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {s: x @ self.p[f"w{s}"] + self.p[f"b{s}"] for s in "fb"}

    def highest(self, texts: list[str | None]) -> np.ndarray:
        """The highest window's logit of each text. Texts are read in groups of about PART_CHARS characters, longer ones in parts."""
        out = np.full(len(texts), -np.inf, np.float32)
        for names, index, of in indexed(texts):
            np.maximum.at(out, of, self.logits(self.gates(self.inputs(names)), index))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.p:
            return np.full(len(texts), 1 / (1 + np.exp(-self.offset)))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.highest(texts).astype(float) + self.offset, -30, 30)))


def parts_of(text: str, most: int):
    """The text in parts of about so many characters that end at white space; a longer word stays whole."""
    at = 0
    while at < len(text):
        to = at + most
        if to < len(text):
            space = SPACE.search(text, to)
            to = space.start() if space else len(text)
        yield text[at:to]
        at = to


def indexed(texts: list[str | None], most: int = PART_CHARS):
    """Groups of windows: distinct words, windows as numbers of these words (from 1; 0 pads), and whose text each window is.

    A part of a long text takes over the last words of the part before, so the windows are those of the whole text.
    """
    known: dict[bytes, int] = {}  # words as they stand, to numbers of stripped words; 0: nothing is left
    names: dict[bytes, int] = {}
    index, of, size = [], [], 0
    for k, text in enumerate(texts):
        carry: list[bytes] = []
        pieces = list(parts_of(text or "", most)) or [""]
        for j, piece in enumerate(pieces):
            words = carry + [w for w in piece.encode().lower().split() if w.strip(AROUND)]
            last = j + 1 == len(pieces)
            count = len(windows(len(words))) if last else max(0, (len(words) - WIDTH) // STRIDE + 1)  # whole ones, but at the end
            if not last and (len(words) - WIDTH) % STRIDE == 0 and count:
                count -= 1  # it may be the last window, which is this one
            for w in set(words).difference(known):
                known[w] = names.setdefault(w.strip(AROUND), len(names) + 1)
            padded = np.zeros(max(len(words), count * STRIDE + WIDTH), np.int32)
            padded[: len(words)] = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
            if count:
                index.append(np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[: count * STRIDE : STRIDE])
                of.append(np.full(count, k))
            carry = words[count * STRIDE :]
            size += len(piece)
            if size >= most:
                if index:
                    yield list(names), np.concatenate(index), np.concatenate(of)
                known, names, index, of, size = {}, {}, [], [], 0
    if index:
        yield list(names), np.concatenate(index), np.concatenate(of)


def log_odds(ids: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    n = np.ones((2, size))
    for x, k in zip(ids, y, strict=True):
        n[k][np.unique(x)] += 1
    total = np.array([max(1, (y == k).sum()) + 2 for k in (0, 1)])
    return np.clip(np.log(n[1] / total[1]) - np.log(n[0] / total[0]), -3, 5) / 2


def backward(net: Net, side: str, keep: list, dh: np.ndarray, x: np.ndarray, mask: np.ndarray, grad: dict) -> np.ndarray:
    """Puts the gradients of a direction into grad; gives that of its inputs."""
    u = net.p[f"u{side}"]
    du, carry, dg = np.zeros_like(u), 0.0, np.zeros((*dh.shape[:2], 3 * HIDDEN), np.float32)
    for t, h, z, r, n, hn in reversed(keep):
        d = (dh[t] + carry) * mask[t]
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        dr = dn * hn * r * (1 - r)
        dg[t] = np.concatenate([dz, dr, dn], axis=1)
        back = np.concatenate([dz, dr, dn * r], axis=1)
        du += h.T @ back
        carry = d * z + back @ u.T
    grad[f"u{side}"] = du
    grad[f"w{side}"] = np.tensordot(x, dg, ([0, 1], [0, 1]))
    grad[f"b{side}"] = dg.sum(axis=(0, 1))
    return dg @ net.p[f"w{side}"].T


def gradients(net: Net, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
    """x: time x batch x inputs. Gradients by the name of the parameter, and "x"."""
    grad: dict = {}
    keep = {"f": [], "b": []}
    h = np.concatenate([net.scan(x @ net.p[f"w{s}"] + net.p[f"b{s}"], mask, s, keep[s]) for s in "fb"], axis=2)
    u, a, pool = net.pooled(h, mask)
    logit = pool @ net.p["w"] + net.p["b"]
    d = (1 / (1 + np.exp(-logit)) - y) / len(y)
    grad["w"], grad["b"] = pool.T @ d, d.sum()
    dpool = d[:, None] * net.p["w"]
    da = (h * dpool).sum(axis=2)
    de = a * (da - (a * da).sum(axis=0))
    dq = (de[..., None] * net.p["va"]) * (1 - u * u)
    grad["va"] = (u * de[..., None]).sum(axis=(0, 1))
    grad["wa"] = np.tensordot(h, dq, ([0, 1], [0, 1]))
    grad["ba"] = dq.sum(axis=(0, 1))
    dh = a[..., None] * dpool + dq @ net.p["wa"].T
    grad["x"] = sum(backward(net, s, keep[s], part, x, mask, grad) for s, part in (("f", dh[..., :HIDDEN]), ("b", dh[..., HIDDEN:])))
    return grad


class Tables:
    """The word and character tables of a network in training, by the distinct words of the texts learned from."""

    def __init__(self, net: Net, words: list[bytes]):
        self.net, self.word = net, np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & ((1 << WORD_BITS) - 1)
        self.code, begin = trigrams(words)
        self.count = np.diff(np.append(begin, len(self.code)))
        self.begin = begin
        self.square = {"word": np.full(len(net.word), 1e-6, np.float32), "char": np.full(len(net.char), 1e-6, np.float32)}

    def step(self, ix: np.ndarray, dx: np.ndarray, rate: float) -> None:
        """One step of the rows that the batch's words (numbers from 1) use, scaled by each row's past gradients."""
        at, of = np.unique(ix[ix > 0] - 1, return_inverse=True)
        g = np.zeros((len(at), 2 * WIDE), np.float32)
        np.add.at(g, of, dx[ix > 0])
        self.moved("word", self.word[at], g[:, :WIDE], rate)
        n = self.count[at]
        codes = self.code[np.repeat(self.begin[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        self.moved("char", codes, np.repeat(g[:, WIDE:] / n[:, None], n, axis=0), rate)

    def moved(self, name: str, rows: np.ndarray, g: np.ndarray, rate: float) -> None:
        table, square = getattr(self.net, name), self.square[name]
        at, of = np.unique(rows, return_inverse=True)
        total = np.zeros((len(at), WIDE), np.float32)
        np.add.at(total, of, g)
        square[at] += (total**2).mean(axis=1)
        table[at] -= rate * total / np.sqrt(square[at])[:, None]


def train(sample: list[tuple[str, int]], share: float, epochs: int = 8, least_steps: int = 1000, batch: int = 48, rate: float = 0.01, table_rate: float = 0.1, seed: int = 5) -> Net:
    """share: of class 1 among all labels. Few texts are gone through more often, for at least so many steps."""
    y = np.array([k for _, k in sample], np.int64)
    draw = np.random.default_rng(seed)
    net = Net((0.3 * draw.standard_normal((1 << WORD_BITS, WIDE))).astype(np.float32), (0.3 * draw.standard_normal((1 << CHAR_BITS, WIDE))).astype(np.float32))
    if len(set(y)) < 2:
        p = min(max(0.5 if not len(y) else float(y[0]), 1e-6), 1 - 1e-6)
        net.offset = float(np.log(p / (1 - p)))
        return net
    back = np.array([zlib.crc32(t.encode()) % 4 == 0 for t, _ in sample])
    if len(set(y[back])) < 2 or len(set(y[~back])) < 2:
        back[:] = False
    learn = np.flatnonzero(~back)
    texts, yl = [sample[i][0] for i in learn], y[learn]
    words = [words_of(t) for t in texts]
    net.word[:, 0] = log_odds([np.fromiter(map(zlib.crc32, w), np.int64, len(w)) & ((1 << WORD_BITS) - 1) for w in words], yl, 1 << WORD_BITS)
    net.char[:, 0] = log_odds([trigrams(w)[0] if w else np.zeros(0, np.int64) for w in words], yl, 1 << CHAR_BITS)
    for s in "fb":
        net.p |= {f"w{s}": (draw.standard_normal((2 * WIDE, 3 * HIDDEN)) * 0.3).astype(np.float32), f"u{s}": (draw.standard_normal((HIDDEN, 3 * HIDDEN)) * 0.3).astype(np.float32), f"b{s}": np.zeros(3 * HIDDEN, np.float32)}
    net.p |= {"wa": (draw.standard_normal((2 * HIDDEN, HIDDEN)) * 0.3).astype(np.float32), "ba": np.zeros(HIDDEN, np.float32), "va": (draw.standard_normal(HIDDEN) * 0.3).astype(np.float32), "w": (draw.standard_normal(2 * HIDDEN) * 0.3).astype(np.float32), "b": np.float32(0)}
    (names, index, of), = indexed(texts, 1 << 62)
    first = np.searchsorted(of, np.arange(len(texts)))
    tables, x = Tables(net, names), net.inputs(names)
    strength = np.where(index > 0, np.maximum(x[index, 0], 0) ** 2, 0).sum(axis=1)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    steps, epoch = 0, 0
    while epoch < epochs or steps < least_steps:
        order = np.lexsort((-strength, of))
        place = np.arange(len(order)) - first[of[order]]
        positive = order[(yl[of[order]] == 1) & (place < 2)]
        clean = order[yl[of[order]] == 0]
        hard = order[(yl[of[order]] == 0) & (place < 1)]
        negative = np.concatenate([hard, draw.choice(clean, min(len(clean), 2 * len(hard)), replace=False)])
        picked = draw.permutation(np.concatenate([positive, negative]))
        for at in range(0, len(picked), batch):
            some = picked[at : at + batch]
            ix = index[some].T
            mask = (ix > 0).astype(np.float32)[..., None]
            xs = x[ix]
            seen = draw.random((*ix.shape, 1)) > 0.25  # now and then only the characters are seen
            xs[..., :WIDE] *= seen
            steps += 1
            grad = gradients(net, xs, mask, yl[of[some]].astype(np.float32))
            dx = grad.pop("x")
            dx[..., :WIDE] *= seen
            tables.step(ix, dx, table_rate)
            for k, g in grad.items():
                m = moment[k]
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.999 * m[1] + 0.001 * g * g
                net.p[k] = (net.p[k] - rate * (m[0] / (1 - 0.9**steps)) / (np.sqrt(m[1] / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)
        epoch, x = epoch + 1, net.inputs(names)
        strength = net.logits(net.gates(x), index)
    test = np.flatnonzero(back) if back.any() else learn
    yt = y[test]
    weight = np.where(yt == 1, share / max(1, (yt == 1).sum()), (1 - share) / max(1, (yt == 0).sum())) * len(yt)
    net.slope, net.offset = logistic_fit(net.highest([sample[i][0] for i in test]).astype(float), np.where(yt == 1, 1, -1), weight)
    return net


def learn_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Net:
    share = labels.where(learn & F.col(label).isin(0, 1)).agg(F.avg(label)).first()[0]
    return train(labelled_sample(docs, labels, label, learn, per_class, max_chars), 0.5 if share is None else float(share))


def score_toxicity(docs: DataFrame, net: Net, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for each row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches):
        for batch in sliced(batches):
            score = sent.value.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, net: Net, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    at, schema = docs.columns.index("text"), docs.schema

    def run(batches):
        for batch in sliced(batches):
            yield batch.filter(pa.array(sent.value.scores(batch.column(at).to_pylist()) < threshold))

    return mapped(docs, run, schema)
