"""Media columns: texts as WAV audio, and spectral-peak pair fingerprints of what was stored.

The payload (the text's bytes, padded with 255 to a positive multiple of BLOCK) is stored as
unsigned 8-bit mono samples by the wave module and read back by it; equal payloads give equal files.
A short-time Fourier transform (Hann window, frames of BLOCK samples, half overlapping) gives the
strongest peak of each of five bands in each frame; a peak that stands out in its frame is paired
with the peaks of the next FAN frames. A payload of one block gets half a frame of silence on both
sides for this, so that it has three frames and pairs too. A fingerprint is f1 << 28 | f2 << 16 | dt with the anchor's
frame in the upper 24 bits: a time-coded array. Frames are handled in blocks, so memory does not
grow with a text beyond its own bytes and fingerprints.

Nulls: a null text is empty, and so stored as one block of 255.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, released, slices, texts

BLOCK = 576
RATE = 8000
BANDS = (1, 12, 32, 72, 144, 289)
FAN = 2
LOUD = 2.5  # times the frame's mean magnitude, for a peak to count
FRAMES = 512  # frames transformed at once

_HANN = np.hanning(BLOCK).astype(np.float32)


def payload(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // BLOCK)) * BLOCK, b"\xff")


def to_wav(data: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frequency bin of the strongest peak of each band and frame, whether it counts)."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, BLOCK)[:: BLOCK // 2]
    bins, loud = [], []
    for i in range(0, len(frames), FRAMES):
        block = (frames[i : i + FRAMES].astype(np.float32) - 128) * _HANN
        size = np.abs(np.fft.rfft(block, axis=1)).astype(np.float32)
        mean = size[:, 1:].mean(axis=1)
        bins.append(np.column_stack([a + size[:, a:b].argmax(axis=1) for a, b in zip(BANDS[:-1], BANDS[1:], strict=True)]))
        loud.append(np.column_stack([size[:, a:b].max(axis=1) > LOUD * mean for a, b in zip(BANDS[:-1], BANDS[1:], strict=True)]))
    return np.concatenate(bins), np.concatenate(loud)


def fingerprints(samples: np.ndarray) -> np.ndarray:
    """Sorted 64-bit time-coded fingerprints: anchor frame << 40 | f1 << 28 | f2 << 16 | frames between."""
    if len(samples) <= BLOCK:
        samples = np.pad(samples, BLOCK // 2, constant_values=128)
    bins, loud = peaks(samples)
    out = [np.zeros(0, np.int64)]
    for dt in range(1, FAN + 1):
        both = loud[:-dt, :, None] & loud[dt:, None, :]
        t, i, j = np.nonzero(both)
        out.append(t.astype(np.int64) << 40 | bins[t, i].astype(np.int64) << 28 | bins[t + dt, j].astype(np.int64) << 16 | dt)
    return np.sort(np.concatenate(out))


SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, media binary, fingerprints array<bigint>"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """SCHEMA for every row; with keep_media=False `media` is null, which saves its transport. `feature` is the number of fingerprints and a digest of them all."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.int64())]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in slices(batches):
            out: list[list] = [[] for _ in kinds]
            for text in texts(batch):
                stored = to_wav(payload(text))
                back = from_wav(stored)
                marks = fingerprints(np.frombuffer(back, np.uint8))
                row = (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{len(marks)}:{hashlib.blake2b(marks.tobytes(), digest_size=16).hexdigest()}", stored if keep_media else None, marks)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names)

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
