"""Media columns: WAV bytes by the wave module, short-time Fourier transforms, spectral-peak pair fingerprints.

A text's UTF-8 bytes, padded with spaces to a positive multiple of `frame`, are stored as 8-bit mono
samples of a WAV file; everything else is computed from the samples read back from that file. Each
frame's strongest spectral peaks are paired with peaks of the next frames; a pair is kept as
(time, code) with code = frequency, frequency, time difference, in two parallel arrays.

Null or empty text is one frame of spaces. Equal texts get equal values. Rows are independent, so ties,
repeated rows and empty tables need no care; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import sliced

FRAME, RATE, PEAKS, FAN, BLOCK = 192, 8000, 2, 2, 8192


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray, frame: int = FRAME) -> np.ndarray:
    """Frequencies of the PEAKS strongest local maxima of each half-overlapping frame; 0 where there are fewer."""
    hop, out, window = frame // 2, [], np.hanning(frame).astype(np.float32)
    count = max(1, (len(samples) - frame) // hop + 1)
    for at in range(0, count, BLOCK):
        n = min(BLOCK, count - at)
        part = samples[at * hop : at * hop + (n - 1) * hop + frame].astype(np.float32) - 128
        framed = np.lib.stride_tricks.sliding_window_view(part, frame)[::hop] * window
        power = np.abs(np.fft.rfft(framed, axis=1)).astype(np.float32)
        mid = power[:, 1:-1]
        top = np.where((mid > power[:, :-2]) & (mid >= power[:, 2:]) & (mid > 1e-3), np.round(mid, 2), 0)
        best = np.empty((n, PEAKS), np.int64)
        rows = np.arange(n)
        for k in range(PEAKS):
            best[:, k] = top.argmax(axis=1)
            found = top[rows, best[:, k]] > 0
            top[rows, best[:, k]] = 0
            best[:, k] = np.where(found, best[:, k] + 1, 0)
        out.append(best)
    return np.concatenate(out)


def fingerprint(samples: np.ndarray, frame: int = FRAME) -> tuple[np.ndarray, np.ndarray]:
    """Times (frame numbers) and codes of peak pairs, by time, then code."""
    best = peaks(samples, frame)
    times, codes = [], []
    for dt in range(1, FAN + 1):
        a, b = best[:-dt], best[dt:]
        for i in range(PEAKS):
            for j in range(PEAKS):
                hit = np.flatnonzero((a[:, i] > 0) & (b[:, j] > 0))
                times.append(hit)
                codes.append((a[hit, i] << 16) | (b[hit, j] << 8) | dt)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.argsort((t << 24) | c, kind="stable")
    return t[order].astype(np.int32), c[order].astype(np.int32)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_peak_pairs long, feature string"


def media_features(docs: DataFrame, frame: int = FRAME, keep_media: bool = True) -> DataFrame:
    """SCHEMA for each row of docs (doc_id, text), with the media column (WAV bytes) and the arrays times, codes unless keep_media is off."""

    def run(batches):
        for batch in sliced(batches):
            rows = {k.split(" ")[0]: [] for k in SCHEMA.split(", ")[1:]} | ({"media": [], "times": [], "codes": []} if keep_media else {})
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode()
                stored = to_wav(raw.ljust(max(1, -(-len(raw) // frame)) * frame))
                payload = from_wav(stored)
                times, codes = fingerprint(np.frombuffer(payload, np.uint8), frame)
                for k, v in {
                    "n_bytes": len(raw), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]),
                    "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(), "n_peak_pairs": len(times),
                    "feature": hashlib.sha256(times.astype("<i4").tobytes() + codes.astype("<i4").tobytes()).hexdigest()[:32],
                }.items():
                    rows[k].append(v)
                if keep_media:
                    rows["media"].append(stored)
                    rows["times"].append(times)
                    rows["codes"].append(codes)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows.values())], ["doc_id", *rows])

    extra = ", media binary, times array<int>, codes array<int>" if keep_media else ""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA + extra)
