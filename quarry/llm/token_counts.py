"""Token counts of whole texts, with overlap resynchronisation for huge documents.

A huge document is encoded in overlapping chunks with offsets. Two neighbouring encodings are spliced at
a character position where both start a token and where the text itself proves that no token and no
pre-token can span it (see stable()). If the overlap holds no such position it is widened, in the end to
the whole unspliced rest, so the result is always the library's own. Only .json vocabularies are spliced; a text
for a .model vocabulary is encoded in one piece, however long.

Null text counts as empty: 0 bytes, 0 tokens. Rows are handled one by one, so repeated rows, ties and
empty tables need no special care; other columns of the input are not read and cannot clash.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import sliced

MEMO_WORDS, MEMO_BYTES = 400_000, 48
#: May follow a word as a pre-token of its own; an apostrophe may not, as it can start one.
MARKS = b'!"#$%&()*+,-./:;<=>?@[]^_`{|}~'
HUGE, CHUNK, OVERLAP = 32_768, 16_384, 256


class Encoder:
    """A public tokenizer. Its memo of words lives as long as the Python worker and is bounded.

    If white space only separates tokens (as in a vocabulary with word ends), a text's ids are those of
    its words one after another, and a word's ids are looked up instead of encoded again.
    """

    def __init__(self, path: str):
        self.path, self.memo, self.pieces, self.fast = path, {}, None, None
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.by_words = False
        else:
            from tokenizers import Tokenizer

            self.tok = Tokenizer.from_file(path)
            self.tok.no_truncation()
            self.tok.no_padding()
            self.by_words = self.ids("A b\n c") == self.ids("a") + self.ids("B") + self.ids("c") == self.ids(" \ta\x0bb\x0c c\r")
            self.fast = plain_words(path, self.tok) if self.by_words else None

    def ids(self, text: str) -> list[int]:
        if self.pieces is not None:
            return self.pieces.encode(text, num_threads=1)
        return self.tok.encode(text, add_special_tokens=False).ids

    def starts(self, text: str) -> np.ndarray:
        """Where each token starts, in characters."""
        return np.array([a for a, _ in self.tok.encode(text, add_special_tokens=False).offsets], np.int64)

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not self.by_words:
            return np.array(self.ids(text), "<u4").tobytes()
        raw = text.encode()
        words, memo = (raw if b"<|" in raw else raw.lower()).split(), self.memo  # the tokenizer lower-cases all but special strings
        if missing := list(set(words).difference(memo)):
            if len(memo) + len(missing) > MEMO_WORDS:
                memo.clear()
                missing = list(set(words))
            rare, fast, hard = {}, self.fast, []
            for w in missing:
                if fast is None or (got := fast(w)) is None:
                    hard.append(w)
                elif len(w) <= MEMO_BYTES and len(memo) < MEMO_WORDS:
                    memo[w] = got
                else:
                    rare[w] = got
            for at in range(0, len(hard), 4096):
                some = hard[at : at + 4096]
                for w, e in zip(some, self.tok.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                    (memo if len(w) <= MEMO_BYTES and len(memo) < MEMO_WORDS else rare)[w] = np.array(e.ids, "<u4").tobytes()
            if rare:
                return b"".join([memo[w] if w in memo else rare[w] for w in words])
        return b"".join(map(memo.__getitem__, words))


def plain_words(path: str, tok):
    """A function that gives the packed ids of a plain word (small Latin letters, then only punctuation),
    or None for any other, with the same vocabulary and merge order in a byte-pair library that is faster
    on single words; None if the vocabulary isn't of that kind.

    A word end is written as byte 255, which UTF-8 never holds; it joins the last byte before all else.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or not isinstance(model["vocab"], dict):
        return None
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE writes these bytes as they are
    byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - {*visible}))}

    def spelled(token: str) -> bytes:
        end = token.endswith("</w>")
        return bytes(byte_of[c] for c in (token[:-4] if end else token)) + b"\xff" * end

    ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 255]): 256 + b for b in range(256)}
    ids = {bytes([b]): model["vocab"].get(c) for c, b in byte_of.items()} | {bytes([b, 255]): model["vocab"].get(f"{c}</w>") for c, b in byte_of.items()}
    for left, right in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
        ids[word := spelled(left + right)] = model["vocab"][left + right]
        ranks.setdefault(word, len(ranks))
    real = np.zeros(len(ranks), np.uint32)
    for word, rank in ranks.items():
        real[rank] = ids[word] if ids.get(word) is not None else 0xFFFFFFFF
    piece = tiktoken.Encoding("words", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    real, marks = real.tolist(), {b"": b""}

    def fast(word: bytes) -> bytes | None:
        body = word.rstrip(MARKS)
        if not body.isalpha() or not body.islower():  # capitals stay in texts with special strings
            text = body.decode()
            if not text.isalpha() or not text.islower() or max(text) > "\u017e" or "\u0149" in text:
                return None
        if (mark := word[len(body) :]) not in marks:
            found = array("I", [real[i] for i in piece(mark + b"\xff")]).tobytes()
            if len(marks) >= 10_000:
                return array("I", [real[i] for i in piece(body + b"\xff")]).tobytes() + found
            marks[mark] = found
        return array("I", [real[i] for i in piece(body + b"\xff")]).tobytes() + marks[mark]

    probe = [b"the", b"word,", "\u00e9t\u00e9.".encode(), b"zzqxv", b"ab###", b"so.!!"]
    if any(fast(w) != np.array(tok.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes() for w in probe):
        return None
    return fast


@functools.lru_cache(4)
def encoder(path: str) -> Encoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def stable(text: str, p: int, by_words: bool) -> bool:
    """Whether text[:p] and text[p:] are surely tokenised apart.

    With tokens that never touch white space: white space stands before p. Otherwise: a space stands at p
    between a non-space and a letter or digit, where a pre-token that may hold one leading space begins.
    """
    if by_words:
        return text[p - 1] in " \t\n\x0b\x0c\r"
    return text[p] == " " and not text[p - 1].isspace() and p + 1 < len(text) and text[p + 1].isascii() and text[p + 1].isalnum()


def resynced(enc: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[int]:
    """Tokens between one proven cut and the next."""
    size, cut, a0, a1 = len(text), 0, 0, min(len(text), chunk)
    a = enc.starts(text[a0:a1]) + a0
    while a1 < size:
        width, spliced = overlap, False
        while not spliced:
            b0 = max(a1 - width, cut)
            b1 = min(size, b0 + max(chunk, 2 * width))
            b = enc.starts(text[b0:b1]) + b0
            common = [p for p in np.intersect1d(a, b).tolist() if max(b0, cut) < p < a1 and stable(text, p, enc.by_words)]
            if common:
                p = common[len(common) // 2]
                yield int(np.searchsorted(a, p) - np.searchsorted(a, cut))
                cut, a0, a1, a, spliced = p, b0, b1, b, True
            elif b0 <= cut:  # no boundary since the last cut: the rest since then becomes one wider chunk
                a0, a1 = cut, min(size, cut + 2 * (b1 - cut))
                a, spliced = enc.starts(text[a0:a1]) + a0, True
            else:
                width *= 2
    yield int(len(a) - np.searchsorted(a, cut))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text)."""

    def run(batches):
        enc = encoder(tokenizer)
        for batch in sliced(batches):
            counts = []
            for text in batch.column(1).to_pylist():
                if not text:
                    counts.append(0)
                elif len(text) > huge and enc.pieces is None:
                    counts.append(sum(resynced(enc, text, chunk, overlap)))
                else:
                    counts.append(len(enc.packed(text)) // 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
