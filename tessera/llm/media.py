"""Media columns: texts stored as WAV, read by the wave module, described by spectral-peak pairs.

Stored form: mono, 8-bit unsigned samples. The samples are the payload's bytes, one for one. From the samples that are
read back, a short-time Fourier transform (Hann window) gives each frame's strongest local maxima. A peak forms a pair with every peak of its target
zone, the weaker ones of its own frame and all of the next REACH frames; a pair is one number that holds the time, both bins and the distance, and
the pairs of a text are an array in ascending order.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tessera.llm import _common as C

UNIT, RATE = 576, 8000
FRAME, HOP, PEAKS, REACH = 576, 288, 3, 3
_WINDOW = np.hanning(FRAME).astype(np.float32)


def payload_of(text: str | None) -> bytes:
    """UTF-8 and bytes 255 up to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("not a mono 8-bit WAV")
        return r.readframes(r.getnframes())


def _peaks(samples: np.ndarray) -> np.ndarray:
    """Bins of the PEAKS strongest local maxima of each frame, strongest first, by blocks of frames; 0 where there are fewer."""
    x = samples.astype(np.float32) - 128
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    found = []
    for at in range(0, len(frames), 1024):
        m = np.abs(np.fft.rfft(frames[at : at + 1024] * _WINDOW, axis=1)).astype(np.float32).round(1)
        inner = np.where((m[:, 1:-1] > m[:, :-2]) & (m[:, 1:-1] >= m[:, 2:]), m[:, 1:-1], 0)
        for k in range(PEAKS):
            best = inner.argmax(axis=1)
            there = inner[np.arange(len(inner)), best] > 0
            if not k:
                tops = np.zeros((len(inner), PEAKS), np.int64)
            tops[:, k] = np.where(there, best + 1, 0)
            inner[np.arange(len(inner)), best] = 0
        found.append(tops)
    return np.concatenate(found)


def peak_pairs(payload: bytes) -> np.ndarray:
    """Time-coded pairs, ascending: frame << 24 | bin << 14 | later bin << 4 | frames between."""
    tops = _peaks(np.frombuffer(payload, np.uint8))
    out = []
    for gap in range(min(REACH, len(tops) - 1) + 1):
        t = np.arange(len(tops) - gap)[:, None, None]
        a, b = tops[: len(tops) - gap, :, None], tops[gap:, None, :]
        ok = (a > 0) & (b > 0) & (np.triu(np.ones((PEAKS, PEAKS), bool), 1) if not gap else True)
        out.append((t << 24 | a << 14 | b << 4 | gap)[ok])
    return np.sort(np.concatenate(out)) if out else np.empty(0, np.int64)


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (WAV); one row for a row, repeated rows too. A null text counts as empty; a very long one is stored whole; ids pass through,
    null or repeated; other columns, whatever their names, are not read. An empty table gives an empty one."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield doc_id, len((text or "").encode()), to_wav(payload_of(text))

    return C.arrow_map(C.texts(docs, id_col, text_col), run, f"doc_id {kind}, n_bytes long, media binary", rows=256)


def describe_media(media: DataFrame) -> DataFrame:
    """Reads the ``media`` column back: payload figures, the stored form's figures, ``pairs`` array<long> and ``feature`` (frames, pairs and a
    hash of all pairs). Rows as they are; a row whose media is no mono 8-bit WAV raises."""
    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, pairs array<long>, feature string"

    def run(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, n, stored in zip(*(batch.column(i).to_pylist() for i in range(3))):
            payload = from_wav(stored)
            pairs = peak_pairs(payload)
            feature = f"{(len(payload) - FRAME) // HOP + 1}-{len(pairs)}-{xxhash.xxh3_128_hexdigest(pairs.astype('<i8').tobytes())}"
            yield doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), pairs, feature

    return C.arrow_map(media.select("doc_id", "n_bytes", "media"), run, schema, rows=256)


def media_table(docs: DataFrame, path: str | None = None, **cols: str) -> DataFrame:
    """Stores the media column as a table in the shared folder (or at ``path``) and describes what is read back from it."""
    return describe_media(C.stored(encode_media(docs, **cols), "media", path))


def op3_media_columns(spark, sf_dir: str) -> DataFrame:
    return media_table(C.table(spark, sf_dir, "documents"))
