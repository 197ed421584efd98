"""Audio features: bytes stored as 8-bit samples, resampled, turned into log-mel frames and segmented by energy.

The stored form is a WAV file of unsigned 8-bit mono samples. Read back, its samples go through a polyphase FIR
resampler, overlapped windows and a mel filterbank; hysteresis over frame energies gives segments with time spans.
Features are cut into tensors of one fixed shape (frames, mels) for Arrow's fixed-shape tensor type, the last padded.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE_IN, RATE_OUT, WINDOW, HOP, MELS, FRAMES = 16_000, 8_000, 256, 128, 32, 64
#: Samples that are resampled and framed at once, besides those that the filter and the last window reach over: memory per task stays bounded for any length.
BLOCK = 1 << 20


def to_wav(payload: bytes, rate: int = RATE_IN) -> bytes:
    """The payload as a WAV file of unsigned 8-bit mono samples; nothing is lost."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(payload) % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * (len(payload) % 2)


def from_wav(media: bytes) -> tuple[bytes, int]:
    """The samples' bytes and the rate of an 8-bit mono WAV file."""
    with wave.open(io.BytesIO(media)) as f:
        if (f.getsampwidth(), f.getnchannels()) != (1, 1):
            raise ValueError("8-bit mono samples are expected")
        return f.readframes(f.getnframes()), f.getframerate()


@lru_cache(maxsize=8)
def _phases(up: int, down: int, half: int = 8) -> np.ndarray:
    """Windowed-sinc filters, one row for each of the ``up`` phases, taps in the order of the input samples."""
    reach = half * max(up, down) / up
    taps = int(np.ceil(reach)) * 2 + 1
    centre = np.arange(taps) - taps // 2
    t = centre[None, :] - np.arange(up)[:, None] / up
    cut = min(1.0, up / down)
    h = cut * np.sinc(cut * t) * np.clip(0.5 + 0.5 * np.cos(np.pi * np.clip(t / (reach + 1), -1, 1)), 0, 1)
    return (h / h.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, rate_in: int, rate_out: int, first: int = 0, last: int | None = None, scaled=lambda part: part.astype(np.float32)) -> np.ndarray:
    """Polyphase resampling; output k lies at input time k * rate_in / rate_out, beyond the ends is silence.

    Only outputs ``first`` to ``last`` are computed, from the inputs that their filters reach; ``scaled`` makes floats of these.
    """
    g = gcd(rate_in, rate_out)
    up, down = rate_out // g, rate_in // g
    last = n_resampled(len(x), rate_in, rate_out) if last is None else last
    if up == down or last <= first:
        return scaled(x[first:last]).astype(np.float32)
    h = _phases(up, down)
    half = h.shape[1] // 2
    low, high = first * down // up - half, (last - 1) * down // up + half + 1
    part = scaled(x[max(0, low) : high]).astype(np.float32)
    padded = np.concatenate([np.zeros(max(0, -low), np.float32), part, np.zeros(max(0, high - max(len(x), low)), np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, h.shape[1])
    out = np.empty(last - first, np.float32)
    for phase in range(up):  # outputs k with the same phase share a filter and step evenly over the input
        k = np.arange(first + (phase - first) % up, last, up)
        if len(k):
            at, p = k[0] * down // up - half - low, (k[0] * down) % up
            out[k - first] = windows[at :: down][: len(k)] @ h[p]
    return out


def n_resampled(n: int, rate_in: int, rate_out: int) -> int:
    """Number of outputs of n inputs."""
    return -(-n * rate_out // rate_in)


@lru_cache(maxsize=8)
def mel_bank(rate: int, window: int, mels: int) -> np.ndarray:
    """Triangular filters over the bins of a real FFT, evenly spaced on the mel scale: (bins, mels)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(window, 1 / rate)[:, None]
    low, mid, high = points[:-2], points[1:-1], points[2:]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid))).astype(np.float32)


def n_frames(length: int, window: int = WINDOW, hop: int = HOP) -> int:
    """Number of frames of a stretch of samples."""
    return max(1, -(-max(0, length - window) // hop) + 1)


def log_mel(x: np.ndarray, rate: int, window: int = WINDOW, hop: int = HOP, mels: int = MELS) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames (n, mels) and each frame's energy in dB; a frame starts every ``hop`` samples, the tail is padded with silence."""
    n = n_frames(len(x), window, hop)
    x = np.pad(x, (0, max(0, (n - 1) * hop + window - len(x))))
    frames = np.lib.stride_tricks.sliding_window_view(x, window)[::hop][:n]
    taper, bank = np.hanning(window).astype(np.float32), mel_bank(rate, window, mels)
    out, energy = np.empty((n, mels), np.float32), np.empty(n, np.float32)
    for at in range(0, n, 2048):
        part = frames[at : at + 2048]
        spectrum = np.abs(np.fft.rfft(part * taper, axis=1)) ** 2
        out[at : at + 2048] = np.log(spectrum.astype(np.float32) @ bank + 1e-6)
        energy[at : at + 2048] = 10 * np.log10((part.astype(np.float64) ** 2).mean(axis=1) + 1e-10)
    return out, energy


def segments(energy: np.ndarray, high: float | None = None, low: float | None = None) -> list[tuple[int, int]]:
    """Spans [first, end) of active frames: one opens at ``high`` dB and lasts until the energy falls under ``low``.

    Without thresholds: the median and three dB under it.
    """
    if not len(energy):
        return []
    high = float(np.median(energy)) if high is None else high
    low = high - 3 if low is None else low
    mark = np.where(energy >= high, 1, np.where(energy < low, -1, 0))
    known = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    active = np.where(known >= 0, mark[np.maximum(known, 0)] > 0, False)
    turns = np.flatnonzero(np.diff(np.concatenate(([0], active.view(np.int8), [0]))))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))


def audio_features(media: bytes) -> tuple[np.ndarray, list[tuple[int, int]], list[tuple[float, float]]]:
    """Of a WAV file: tensors (k, FRAMES, MELS) of log-mel frames, the time span in ms of each, and active spans in ms."""
    payload, rate = from_wav(media)
    mels, energies = [], []
    samples = np.frombuffer(payload, np.uint8)
    length = n_resampled(len(samples), rate, RATE_OUT)
    n, size = n_frames(length), max(1, BLOCK // (HOP * 2))
    for at in range(0, n, size):  # a block has the samples that its last windows and the filter reach, so that frames are those of the whole
        end = min(n, at + size)
        x = resample(samples, rate, RATE_OUT, at * HOP, min(length, (end - 1) * HOP + WINDOW), lambda part: (part.astype(np.float32) - 128) / 128)
        m, e = log_mel(x, RATE_OUT)
        mels.append(m)
        energies.append(e)
    mel, energy = np.concatenate(mels), np.concatenate(energies)
    k = -(-len(mel) // FRAMES)
    tensors = np.zeros((k, FRAMES, MELS), np.float32)
    tensors.reshape(-1, MELS)[: len(mel)] = mel
    ms = lambda frame: round(frame * HOP * 1000 / RATE_OUT, 3)
    spans = [(int(ms(i * FRAMES)), int(ms(min(len(mel), (i + 1) * FRAMES)))) for i in range(k)]
    return tensors, spans, [(ms(a), ms(b)) for a, b in segments(energy)]


def tensor_array(tensors: np.ndarray) -> pa.FixedShapeTensorArray:
    """Tensors (k, FRAMES, MELS) as Arrow's fixed-shape tensor array, without a copy."""
    return pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(tensors))


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The UTF-8 bytes of a text (null: none), zero-padded to a positive multiple of 64, and their unpadded number."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64)), len(raw)


def encoded_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (id, text) to batches (id, n_bytes, media, tensors, spans, active), a few megabytes of text at a time.

    ``tensors`` is an Arrow list of fixed-shape tensors' storage (fixed-size lists of FRAMES * MELS floats), row by row.
    """
    for batch in batches:
        rows: list[tuple] = []
        held = 0
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            payload, n = payload_of(text.as_py())
            media = to_wav(payload)
            rows.append((key.as_py(), n, media, *audio_features(media)))
            held += len(media)
            if held > 4_000_000:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, sizes, media, tensors, spans, active = zip(*rows, strict=True)
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(t) for t in tensors]))).astype(np.int32))
    fixed = tensor_array(np.concatenate(tensors)).storage
    span = pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())]))
    as_spans = lambda rows: pa.array([[{"start_ms": float(a), "end_ms": float(b)} for a, b in r] for r in rows], span)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.ListArray.from_arrays(offsets, fixed), as_spans(spans), as_spans(active)],
        ["id", "n_bytes", "media", "tensors", "spans", "active"],
    )


SCHEMA = "id long, n_bytes long, media binary, tensors array<array<float>>, spans array<struct<start_ms:double,end_ms:double>>, active array<struct<start_ms:double,end_ms:double>>"


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Media and features of every row: id, n_bytes, media (WAV), tensors, the tensors' time spans, active spans.

    Null and empty texts are 64 zero bytes; equal texts have equal values; null ids and repeated rows are kept; other columns of
    docs are not looked at; an empty table gives an empty result. Very long texts are worked on in blocks of about BLOCK samples, with
    the features of the whole.
    """
    return _narrow(docs, id_col, text_col).mapInArrow(encoded_batches, SCHEMA)


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in encoded_batches(batches):
        out = []
        for at in range(batch.num_rows):
            media = batch.column(2)[at].as_py()
            payload, _ = from_wav(media)
            tensors = batch.column(3)[at].values
            values = tensors.flatten().to_numpy(zero_copy_only=False).tobytes()
            spans = batch.column(5)[at].as_py()
            feature = f"{len(tensors)}x{FRAMES}x{MELS}:{len(spans)}:{sum(s['end_ms'] - s['start_ms'] for s in spans):.0f}:{hashlib.sha256(values).hexdigest()[:32]}"
            out.append((batch.column(0)[at].as_py(), batch.column(1)[at].as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def op6_media(spark, sf_dir: str) -> DataFrame:
    """Digests are taken in the task that made the media and tensors, so that these need not travel."""
    docs = _narrow(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return docs.mapInArrow(_digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
