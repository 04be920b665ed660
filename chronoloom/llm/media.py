"""Media columns: payloads stored as WAV, read back with the `wave` module, and fingerprinted by pairs of spectral peaks.

A text is stored losslessly as unsigned 8-bit mono samples. The fingerprint of a recording is the list of pairs of peaks of its short-time Fourier
transform, each a long that codes time, both frequencies and the gap: `frame << 24 | bin << 16 | later bin << 8 | frames between`.
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

from .common import freeing, utf8

FRAME, HOP, RATE = 192, 96, 8000
BANDS = ((2, 12), (12, 28), (28, 56), (56, 97))
FAN, REACH = 2, 31
BLOCK = 4096


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    with wave.open(out := io.BytesIO(), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        return w.readframes(w.getnframes())


def padded(raw: bytes, unit: int = FRAME) -> bytes:
    return raw.ljust(max(1, -(-len(raw) // unit)) * unit, b" ")


def _loudest(samples: np.ndarray, frames: int) -> tuple[np.ndarray, np.ndarray]:
    """The loudest bin of each band of each frame, and its power; frames are worked off in blocks, so memory doesn't grow with a recording."""
    window = np.hanning(FRAME).astype(np.float32)
    bins, power = np.zeros((frames, len(BANDS)), np.int64), np.zeros((frames, len(BANDS)), np.float32)
    for at in range(0, frames, BLOCK):
        n = min(BLOCK, frames - at)
        cut = samples[at * HOP : (at + n - 1) * HOP + FRAME].astype(np.float32) - 128
        spectrum = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(cut, FRAME)[::HOP] * window)
        energy = spectrum.real**2 + spectrum.imag**2
        for k, (lo, hi) in enumerate(BANDS):
            best = energy[:, lo:hi].argmax(1)
            bins[at : at + n, k], power[at : at + n, k] = best + lo, energy[np.arange(n), best + lo]
    return bins, power


def fingerprint(samples: bytes) -> np.ndarray:
    """Time-coded peak pairs of 8-bit samples, in order of time. A peak is the loudest bin of a band, louder than in the frames beside it."""
    x = np.frombuffer(samples, np.uint8)
    frames = (len(x) - FRAME) // HOP + 1
    if frames < 1:
        return np.zeros(0, np.int64)
    bins, power = _loudest(x, frames)
    edge = np.full((1, len(BANDS)), -1, np.float32)
    peak = (power > np.vstack([edge, power[:-1]])) & (power >= np.vstack([power[1:], edge])) & (power > 1)  # what is left of a steady tone is rounding
    t, band = np.nonzero(peak)
    f = bins[t, band]
    codes = []
    for k in range(1, FAN + 1):
        gap = t[k:] - t[:-k]
        near = gap <= REACH
        codes.append((t[:-k] << 24 | f[:-k] << 16 | f[k:] << 8 | gap)[near])
    return np.sort(np.concatenate(codes))


def media_column(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_media: bool = True) -> DataFrame:
    """(key, n_bytes, media, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, fingerprint array<bigint>).

    The payload is a text's UTF-8, with spaces up to a positive multiple of 192; all digests are taken from what `wave` reads back. A null text is an
    empty one, so its payload is 192 spaces and its fingerprint has no pairs (a steady tone has none). Each row is worked on alone: repeated rows and
    null keys come out as they are, very long texts in blocks of frames. Other columns are dropped, so their names can't clash.
    """
    fields = f"{key} long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fingerprint array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[] for _ in range(8)]
                for raw in part.column(1):
                    raw = raw.as_buffer().to_pybytes()
                    media = to_wav(padded(raw))
                    back = from_wav(media)
                    row = len(raw), media if keep_media else None, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), fingerprint(back)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                kinds = pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())
                names = [x.split()[0] for x in fields.split(", ")]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], names)

    return docs.select(docs[key].cast("long").alias(key), utf8(text).alias("raw")).mapInArrow(freeing(run), fields)
