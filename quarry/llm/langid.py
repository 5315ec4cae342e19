"""Language identification by rank-order n-gram profiles and out-of-place distance.

A profile is the list of the most frequent character n-grams (1 to 3 letters of lower-cased text, `_` for
what stands between words), most frequent first, ties by code points. A document's own list is compared
with each language's: the sum of the differences of ranks, `size` for an n-gram that a profile lacks.

Profiles are learned from about `per_lang` documents of each language at most, drawn by a seeded hash of doc_id
and text; rows that repeat count once among those drawn. Texts are counted whole, long ones in chunks.
Null text or text without a letter gets `und` and score 0, and so does all if nothing could be learned.
Equal distances go to the language that sorts first. Rows are independent: repeated rows get equal
results; other columns of the input are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import sliced

PROFILE, PER_LANG, CHUNK = 400, 1500, 1 << 18


@functools.cache
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams, sorted, and their counts; a text of any length is counted in chunks, so memory for it is bounded."""
    lower, gap = f" {text.lower()} ", ord("_")
    tail, parts = np.zeros(0, np.int64), []  # the last two characters before the chunk
    for at in range(0, len(lower), chunk):
        c = np.frombuffer(lower[at : at + chunk].encode("utf-32-le", "replace"), np.uint32)
        c = np.where(letters()[c], c, gap).astype(np.int64)
        keep = (c != gap) | (np.concatenate([tail[-1:] if len(tail) else [0], c[:-1]]) != gap)
        c = c[keep]
        both = np.concatenate([tail, c])
        two = (both[:-1] << 21) | both[1:]
        codes = np.concatenate([c[c != gap], two[max(0, len(tail) - 1) :], ((two[:-1] << 21) | both[2:])])
        parts.append(np.unique(codes, return_counts=True))
        tail = both[-2:]
        if len(parts) > 1:
            parts = [merged(parts)]
    return parts[0]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes, sorted, and the sums of their counts."""
    codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    return codes[np.argsort(-counts, kind="stable")[:size]]


def learn_profiles(docs: DataFrame, learn: Column, size: int = PROFILE, per_lang: int = PER_LANG) -> dict[str, list[int]]:
    """The profile of each language in docs (doc_id, text, lang) among rows that satisfy `learn`.

    Only sampled texts are shuffled. The counts of the languages come to the driver, as the profiles do: a row a language.
    """
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    n = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return {}
    rates = docs.sparkSession.createDataFrame([(k, min(1.0, per_lang / v)) for k, v in n.items()], "lang string, _rate double")
    unit = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1_000_003)) / 1_000_003
    sample = known.join(F.broadcast(rates), "lang").where(unit < F.col("_rate")).select("lang", "text").distinct()

    def count(frames):
        for frame in frames:
            for lang, texts in frame.groupby("lang")["text"]:
                codes, counts = merged([grams(t) for t in texts])
                yield pd.DataFrame({"lang": lang, "code": codes, "n": counts})

    total = sample.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # one language's n-grams may be in all rows: the first `size` of each of 64 parts, then of these
    part = F.pmod(F.xxhash64("code"), F.lit(64)).alias("_p")
    best = total.withColumn("_p", part).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_p").orderBy(F.desc("n"), "code"))).where(F.col("_r") <= size)
    best = best.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("_r") <= size)
    out: dict[str, list[int]] = {}
    for r in sorted(best.collect(), key=lambda r: (r["lang"], r["_r"])):  # `size` rows for each language
        out.setdefault(r["lang"], []).append(r["code"])
    return out


def identify(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs (doc_id, text)."""
    langs = sorted(profiles)
    known = np.unique(np.concatenate([np.array(profiles[k], np.int64) for k in langs])) if langs else np.zeros(0, np.int64)
    place = np.full((len(known) + 1, len(langs)), -1, np.int64)
    for k, lang in enumerate(langs):
        place[np.searchsorted(known, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def judge(text: str | None) -> tuple[str, float]:
        if not text or not langs:
            return "und", 0.0
        codes, counts = grams(text)
        top = ranked(codes, counts, size)
        if top.size == 0 or not (codes < 1 << 21).any():
            return "und", 0.0
        at = np.searchsorted(known, top)
        at[at == len(known)] = 0
        there = place[np.where(known[at] == top, at, len(known))]
        away = np.where(there >= 0, np.abs(there - np.arange(len(top))[:, None]), size).sum(axis=0)
        best = int(away.argmin())
        rest = np.delete(away, best).min() if len(langs) > 1 else size * len(top)
        return langs[best], float(rest / (rest + away[best])) if rest else 0.5

    def run(batches):
        for batch in sliced(batches):
            lang, score = zip(*map(judge, batch.column(1).to_pylist()), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
