"""Operator 4: audio features of 8-bit media, stored as fixed-shape tensors.

A payload is stored losslessly as an 8-bit mono WAV; features are computed from the
stored bytes read back: polyphase resampling to half the rate, overlapped Hann frames, a
log-mel filterbank, and a segmentation of the frame energy with hysteresis (a
segment opens at the high threshold and closes under the low one). Frames are laid into
tensors of the one shape ``TENSOR_SHAPE`` (the last is padded with the floor value). They are stored in the column
``tensors`` as an Arrow IPC stream of a fixed-shape tensor column with the time span that each covers
(``store_tensors``, ``load_tensors``), so a reader gets shape, names and spans from the bytes alone.

Signals are read in blocks of fixed length whatever their size, so equal bytes give
equal features and memory stays bounded.

Defined cases: a null or empty text has an empty payload, padded to 64 zero bytes;
repeated rows are encoded one by one; an empty table gives an empty result; null ids pass through; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SAMPLE_RATE = 8000
UP, DOWN = 1, 2
SIDE_TAPS = 16
FRAME, HOP = 256, 128
N_MELS = 20
TENSOR_FRAMES = 32
TENSOR_SHAPE = (TENSOR_FRAMES, N_MELS)
FLOOR_DB = -100.0
#: Over the median energy of the signal itself.
OPEN_DB, CLOSE_DB = 0.5, 0.2
PAD_TO = 64
BLOCK_SAMPLES = 1 << 16


def pad_payload(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of PAD_TO."""
    return data + b"\0" * (-len(data) % PAD_TO if data else PAD_TO)


def encode_wav(payload: bytes, rate: int = SAMPLE_RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def decode_wav(media: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes()), w.getframerate()


@lru_cache(maxsize=8)
def polyphase_filter(up: int, down: int, side: int = SIDE_TAPS) -> np.ndarray:
    """Branches (up, 2 * side + 1), reversed for correlation, of a Hann-windowed sinc at the narrower of the two bands."""
    t = np.arange(-side * up, side * up + 1)
    h = np.sinc(t / max(up, down)) * np.hanning(len(t) + 2)[1:-1]
    h = np.concatenate([h * up / h.sum(), np.zeros(up - 1)])
    return np.ascontiguousarray(h.reshape(-1, up).T[:, ::-1]).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, side: int = SIDE_TAPS) -> np.ndarray:
    """Polyphase resampling by up / down: one short dot product an output sample, no delay."""
    branches = polyphase_filter(up, down, side)
    n_out = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(side, np.float32), x, np.zeros(side + 1, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * side + 1)
    out = np.empty(n_out, dtype=np.float32)
    for first in range(min(up, n_out)):  # outputs first, first + up, ... share a branch
        begin = first * down // up
        count = len(range(first, n_out, up))
        out[first::up] = windows[begin::down][:count] @ branches[first * down % up]
    return out


@lru_cache(maxsize=8)
def mel_filters(rate: int, n_mels: int = N_MELS, frame: int = FRAME) -> np.ndarray:
    """Triangular filters (bins, mels), evenly spaced on the mel scale up to half the rate."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, n_mels + 2) / 2595) - 1)
    bins = np.arange(frame // 2 + 1) * rate / frame
    rise = (bins[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[None, 2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows in dB and frame energies in dB, each frame about its own mean, so that an offset has no energy; a signal shorter than a frame is padded to one."""
    n = max(1, 1 + (len(x) - FRAME + HOP - 1) // HOP)
    padded = np.concatenate([x, np.zeros(max(0, (n - 1) * HOP + FRAME - len(x)), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP][:n]
    frames = frames - frames.mean(axis=1, keepdims=True)
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=1)).astype(np.float32) ** 2
    mel = 10 * np.log10(np.maximum(power @ mel_filters(rate), np.float32(1e-10)))
    energy = 10 * np.log10(np.maximum(np.mean(frames * frames, axis=1), np.float32(1e-10)))
    return mel, energy


def blocks_of(samples: np.ndarray, block: int) -> Iterator[np.ndarray]:
    """Resampled signal of 8-bit samples about their mean, in blocks: each is resampled with the SIDE_TAPS * DOWN samples on both sides, as the whole would be."""
    side = SIDE_TAPS * DOWN
    centre = np.float32(samples.mean(dtype=np.float64)) if len(samples) else np.float32(0)
    for at in range(0, len(samples), block):
        begin, end = max(0, at - side), min(len(samples), at + block + side)
        x = (samples[begin:end].astype(np.float32) - centre) / 128
        out = resample(x)
        first = (at - begin) * UP // DOWN
        yield out[first : first + -(-min(block, len(samples) - at) * UP // DOWN)]


def hysteresis(energy: np.ndarray, open_db: float, close_db: float) -> list[tuple[int, int]]:
    """Half-open frame runs that start at open_db or more and last while close_db or more holds."""
    loud = np.concatenate([[False], energy >= close_db, [False]])
    edges = np.flatnonzero(loud[1:] != loud[:-1])
    found = []
    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        starts = np.flatnonzero(energy[begin:end] >= open_db)
        if len(starts):
            found.append((begin + int(starts[0]), end))
    return found


def segments_of(energy: np.ndarray) -> list[tuple[int, int]]:
    """Louder stretches of a signal by its own level: they open OPEN_DB over its median energy and last while CLOSE_DB over it holds; an even signal has none."""
    level = float(np.median(energy))
    return hysteresis(energy, level + OPEN_DB, level + CLOSE_DB)


def analyse(media: bytes) -> dict:
    """Features of stored media, read in blocks of a fixed length; frames and segments span blocks as if the signal were whole."""
    payload, rate = decode_wav(media)
    samples = np.frombuffer(payload, dtype=np.uint8)
    out_rate = rate * UP // DOWN
    mels, energies = [], []
    held, left = np.empty(0, dtype=np.float32), -(-len(samples) * UP // DOWN)
    for x in blocks_of(samples, BLOCK_SAMPLES):
        left -= len(x)
        held = np.concatenate([held, x])
        # the last frame alone is padded; until then whole frames go and what they share with later ones stays
        whole = max(0, (len(held) - FRAME) // HOP + 1) if left else 0
        mel, energy = log_mel(held[: (whole - 1) * HOP + FRAME] if left else held, out_rate)
        held = held[whole * HOP :]
        mels.append(mel)
        energies.append(energy)
    mel, energy = np.concatenate(mels), np.concatenate(energies)
    n = -(-len(mel) // TENSOR_FRAMES)
    tensors = np.full((n * TENSOR_FRAMES, N_MELS), FLOOR_DB, dtype=np.float32)
    tensors[: len(mel)] = mel
    seconds = HOP / out_rate
    spans = [(k * TENSOR_FRAMES * seconds, min(len(mel), (k + 1) * TENSOR_FRAMES) * seconds) for k in range(n)]
    segments = [(a * seconds, b * seconds) for a, b in segments_of(energy)]
    return {"payload": payload, "n_frames": len(mel), "tensors": tensors.reshape(n, -1), "spans": spans, "segments": segments, "mean_db": mel.mean(axis=0, dtype=np.float64).astype(np.float32)}


SPAN = pa.struct([("start", pa.float64()), ("end", pa.float64())])
FIELDS = {
    "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(),
    "media_sha256": pa.string(), "n_frames": pa.int64(), "tensors": pa.binary(), "spans": pa.list_(SPAN), "segments": pa.list_(SPAN),
    "mean_db": pa.list_(pa.float32()),
}
DDL = (
    "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, n_frames bigint, "
    "tensors binary, spans array<struct<start: double, end: double>>, segments array<struct<start: double, end: double>>, mean_db array<float>"
)


def _row(text: str | None, keep_media: bool) -> dict:
    data = (text or "").encode()
    media = encode_wav(pad_payload(data))
    found = analyse(media)
    payload = found["payload"]
    span = lambda pairs: [{"start": a, "end": b} for a, b in pairs]
    row = {
        "n_bytes": len(data), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-PAD_TO:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "n_frames": found["n_frames"],
        "tensors": store_tensors(found["tensors"], found["spans"]), "spans": span(found["spans"]), "segments": span(found["segments"]), "mean_db": found["mean_db"],
    }
    return row | ({"media": media} if keep_media else {})


TENSOR = pa.fixed_shape_tensor(pa.float32(), TENSOR_SHAPE, dim_names=["frame", "mel"])
TENSOR_SCHEMA = pa.schema([("tensor", TENSOR), ("start", pa.float64()), ("end", pa.float64())])


def store_tensors(tensors: np.ndarray, spans: list[tuple[float, float]]) -> bytes:
    """Tensors (rows of flattened values) and their spans as an Arrow IPC stream."""
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensors.ravel(), pa.float32()), TENSOR_FRAMES * N_MELS)
    columns = [pa.ExtensionArray.from_storage(TENSOR, flat), *(pa.array([s[i] for s in spans], pa.float64()) for i in (0, 1))]
    out = io.BytesIO()
    with pa.ipc.new_stream(out, TENSOR_SCHEMA) as stream:
        stream.write_batch(pa.RecordBatch.from_arrays(columns, schema=TENSOR_SCHEMA))
    return out.getvalue()


def load_tensors(stored: bytes) -> pa.Table:
    """tensor (fixed shape), start and end of a stored stream."""
    return pa.ipc.open_stream(stored).read_all()


def media_features(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """doc_id, sizes and digests of payload and media, stored tensors, their time spans, energy segments and mean level of each band; one narrow map."""
    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    fields = FIELDS | ({"media": pa.binary()} if keep_media else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                rows = [_row(t.as_py(), keep_media) for t in part.column(1)]
                arrays = [pa.array([r[k] for r in rows], kind_) for k, kind_ in fields.items()]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["doc_id", *fields])

    return source.mapInArrow(run, f"doc_id {kind}, {DDL}" + ", media binary" * keep_media)
