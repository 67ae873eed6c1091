import hashlib
import zlib

import numpy as np
import pytest
from chronoline.llm import media_audio as M


def slow_resample(x, up, down, side):
    t = np.arange(-side * up, side * up + 1)
    h = np.sinc(t / max(up, down)) * np.hanning(len(t) + 2)[1:-1]
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    return np.convolve(stuffed, h * up / h.sum())[side * up : side * up + len(stuffed)][::down]


@pytest.mark.parametrize("up,down,n", [(1, 2, 400), (3, 2, 101), (2, 3, 77), (1, 1, 5), (1, 2, 1)])
def test_polyphase_equals_the_slow_form(up, down, n):
    x = np.random.default_rng(n).standard_normal(n).astype(np.float32)
    assert np.allclose(M.resample(x, up, down), slow_resample(x, up, down, M.SIDE_TAPS), atol=1e-5)


def test_hysteresis():
    energy = np.array([-30, -14, -11, -14, -14, -16, -14, -11, -30], dtype=float)
    assert M.hysteresis(energy, -12, -15) == [(2, 5), (7, 8)]


def test_payload_round_trip_and_odd_rows(odd_docs, no_docs):
    rows = {r["doc_id"]: r["text"] for r in odd_docs.where("doc_id is not null").collect()}
    for r in M.media_features(odd_docs, keep_media=True).where("doc_id is not null").collect():
        data = (rows[r["doc_id"]] or "").encode()
        payload = data + b"\0" * (-len(data) % 64 if data else 64)
        assert M.decode_wav(bytes(r["media"]))[0] == payload and len(payload) % 64 == 0
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest()
        stored = M.load_tensors(bytes(r["tensors"]))
        assert stored.schema.field("tensor").type.shape == list(M.TENSOR_SHAPE) and stored.num_rows == len(r["spans"])
        assert list(zip(stored["start"].to_pylist(), stored["end"].to_pylist())) == [(s["start"], s["end"]) for s in r["spans"]]
    assert M.media_features(no_docs).count() == 0


def test_stored_tensors_are_read_back():
    found = M.analyse(M.encode_wav(M.pad_payload(b"some text " * 2000)))
    table = M.load_tensors(M.store_tensors(found["tensors"], found["spans"]))
    assert np.array_equal(table["tensor"].combine_chunks().to_numpy_ndarray().reshape(-1), found["tensors"].ravel())
    assert found["spans"][0][0] == 0 and found["spans"][-1][1] == pytest.approx(found["n_frames"] * M.HOP / 4000)


def slow_log_mel(x, rate):
    """Frame by frame and filter by filter, with the transform written out."""
    n = max(1, 1 + -(-(len(x) - M.FRAME) // M.HOP))
    x = np.concatenate([x, np.zeros(n * M.HOP + M.FRAME)])
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(rate / 2) * k / (M.N_MELS + 1) / 2595) - 1) for k in range(M.N_MELS + 2)]
    wave = np.exp(-2j * np.pi * np.outer(np.arange(M.FRAME // 2 + 1), np.arange(M.FRAME)) / M.FRAME)
    rows = []
    for k in range(n):
        frame = x[k * M.HOP : k * M.HOP + M.FRAME]
        frame = (frame - frame.mean()) * np.hanning(M.FRAME)
        power, row = np.abs(wave @ frame) ** 2, []
        for low, middle, high in zip(edges, edges[1:], edges[2:]):
            hertz = np.arange(M.FRAME // 2 + 1) * rate / M.FRAME
            row.append(sum(p * min((h - low) / (middle - low), (high - h) / (high - middle)) for p, h in zip(power, hertz) if low < h < high))
        rows.append(10 * np.log10(np.maximum(row, 1e-10)))
    return np.array(rows)


@pytest.mark.parametrize("n", [1, 200, 257, 2000])
def test_log_mel_equals_the_slow_form(n):
    x = np.random.default_rng(n).standard_normal(n).astype(np.float32)
    assert np.allclose(M.log_mel(x, 4000)[0], slow_log_mel(x, 4000), atol=2e-2)


@pytest.mark.parametrize("n", [65536, 65600, 131072, 200_000, 65536 * 3 + 64])
def test_blocks_equal_the_whole_signal(n):
    r = np.random.default_rng(n)
    payload = M.pad_payload((128 + 100 * np.sin(np.arange(n) / 7) * (r.random(n // 1000 + 1) > 0.5).repeat(1000)[:n]).astype(np.uint8).tobytes())
    samples = np.frombuffer(payload, np.uint8)
    whole = M.resample((samples.astype(np.float32) - np.float32(samples.mean(dtype=np.float64))) / 128)
    mel, energy = M.log_mel(whole, 4000)
    found = M.analyse(M.encode_wav(payload))
    assert found["n_frames"] == len(mel)
    assert np.allclose(found["tensors"].reshape(-1, M.N_MELS)[: len(mel)], mel, atol=1e-2)
    assert found["spans"][-1][1] == pytest.approx(len(mel) * M.HOP / 4000)
    assert found["segments"] == [(a * (M.HOP / 4000), b * (M.HOP / 4000)) for a, b in M.segments_of(energy)]


def test_segments_follow_the_loud_stretches_whatever_the_offset():
    t = np.arange(120_000)
    loud = (t // 10_000) % 3 == 1
    for offset in (128, 100):
        samples = np.where(loud, offset + 60 * np.sin(t / 5), offset + 3 * np.sin(t / 5)).astype(np.uint8)
        found = M.analyse(M.encode_wav(samples.tobytes()))["segments"]
        assert len(found) == 4
        for k, (a, b) in enumerate(found):
            assert abs(a - (3 * k + 1) * 1.25) < 0.1 and abs(b - (3 * k + 2) * 1.25) < 0.1
    assert M.analyse(M.encode_wav(bytes([90]) * 6400))["segments"] == []


def test_segments_tell_texts_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = [len(r["segments"]) for r in M.media_features(docs).where("n_bytes > 2000").collect()]
    assert len(found) > 100 and len(set(found)) > 5 and np.mean(np.array(found) > 1) > 0.3
