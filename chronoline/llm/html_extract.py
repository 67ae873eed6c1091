"""Operator 6: main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks. Each block is a vector of hashed
tag-path parts, hashed words and a few ratios; a bidirectional LSTM in numpy reads the
whole sequence, so every block is judged in the context of the whole page, and the blocks judged
main are joined. The model is trained here, on synthetic pages with known
labels (``html_training``), with a fixed seed; its few tens of kilobytes travel with the
task.

Defined cases: a null or empty html, or one without text, gives an empty text; broken markup is read
as far as it goes; repeated rows are extracted one by one; an empty table
gives an empty result; null ids and urls pass through; other columns are ignored. Pages of any length are
read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronoline.llm.html_blocks import Block, leaf_blocks
from chronoline.llm.html_training import labelled_pages

PATH_ROWS = 1024
WORD_ROWS = 256
DENSE = 8
WIDTH = 24
HIDDEN = 16
TRAIN_PAGES = 2000
TRAIN_SEED = 20
EPOCHS = 16
BATCH_BLOCKS = 20_000


def _path_rows(path: tuple[str, ...]) -> list[int]:
    return sorted({zlib.crc32(p.encode()) % PATH_ROWS for p in path} | {zlib.crc32(b"leaf:" + path[-1].encode()) % PATH_ROWS if path else 0})


def _word_rows(text: str) -> list[int]:
    return [PATH_ROWS + zlib.crc32(w) % WORD_ROWS for w in set(text.lower().encode().split())]


def _dense(b: Block, i: int, n: int, run: int) -> tuple[float, ...]:
    size = len(b.text)
    words = b.text.count(" ") + 1
    return (
        min(1.0, np.log1p(size) / 8), min(1.0, b.link_chars / size), min(1.0, words / 60), i / n, (n - i - 1) / n,
        sum(map(b.text.count, ".!?,")) / words, float("©" in b.text), min(1.0, run / 5),
    )


class Batch:
    """Padded sequences: bag indices with weights, dense columns and lengths."""

    def __init__(self, pages: list[list[Block]]):
        self.lengths = np.array([len(p) for p in pages])
        self.n, self.t = len(pages), int(self.lengths.max())
        rows, cols, weights = [], [], []
        dense = np.zeros((self.n * self.t, DENSE), dtype=np.float32)
        cached: dict[tuple[str, ...], list[int]] = {}
        for p, blocks in enumerate(pages):
            run = 0
            for i, b in enumerate(blocks):
                at = p * self.t + i
                run = run + 1 if i and blocks[i - 1].path == b.path else 0
                dense[at] = _dense(b, i, len(blocks), run)
                path = cached.get(b.path)
                if path is None:
                    path = cached[b.path] = _path_rows(b.path)
                words = _word_rows(b.text)
                rows += [at] * (len(path) + len(words))
                cols += path
                cols += words
                weights += [1.0] * len(path) + [1.0 / max(1, len(words))] * len(words)
        self.dense = dense
        self.rows, self.cols, self.weights = np.array(rows), np.array(cols), np.array(weights, dtype=np.float32)
        self.by_col = np.argsort(self.cols, kind="stable")
        self.col_starts = np.flatnonzero(np.diff(self.cols[self.by_col], prepend=-1))
        self.mask = np.arange(self.t)[None, :] < self.lengths[:, None]
        self.back = np.where(self.mask, self.lengths[:, None] - 1 - np.arange(self.t)[None, :], np.arange(self.t)[None, :])

    def embed(self, table: np.ndarray, dense_w: np.ndarray, bias: np.ndarray) -> np.ndarray:
        x = self.dense @ dense_w + bias
        order = np.flatnonzero(np.diff(self.rows, prepend=-1))
        if len(order):
            x[self.rows[order]] += np.add.reduceat(table[self.cols] * self.weights[:, None], order, axis=0)
        return np.tanh(x).reshape(self.n, self.t, WIDTH)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, learn: bool = True):
    """Hidden states (n, t, h) and, to learn, what the backward pass needs."""
    n, t, _ = x.shape
    h, c = np.zeros((n, HIDDEN), dtype=x.dtype), np.zeros((n, HIDDEN), dtype=x.dtype)
    pre, out, tape = x @ w + b, np.empty((n, t, HIDDEN), dtype=x.dtype), []
    for k in range(t):
        g = pre[:, k] + h @ u
        s = _sigmoid(g[:, : 3 * HIDDEN])
        i, f, o, a = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
        c_new = f * c + i * a
        tc = np.tanh(c_new)
        if learn:
            tape.append((i, f, o, a, c, tc, h))
        h, c = o * tc, c_new
        out[:, k] = h
    return out, tape


def lstm_backward(x: np.ndarray, tape, d_out: np.ndarray, w: np.ndarray, u: np.ndarray):
    n, t, _ = x.shape
    dh, dc = np.zeros((n, HIDDEN), dtype=x.dtype), np.zeros((n, HIDDEN), dtype=x.dtype)
    dg_all, du = np.empty((n, t, 4 * HIDDEN), dtype=x.dtype), np.zeros_like(u)
    for k in range(t - 1, -1, -1):
        i, f, o, a, c, tc, h = tape[k]
        dh = dh + d_out[:, k]
        dc = dc + dh * o * (1 - tc * tc)
        dg = np.concatenate([dc * a * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - a * a)], axis=1)
        dg_all[:, k] = dg
        du += h.T @ dg
        dh, dc = dg @ u.T, dc * f
    return dg_all @ w.T, np.tensordot(x, dg_all, axes=([0, 1], [0, 1])), du, dg_all.sum(axis=(0, 1))


class Labeller:
    """Bidirectional LSTM over block vectors; parameters in one dict of arrays."""

    def __init__(self, seed: int = TRAIN_SEED):
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) * 0.5 / np.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "table": (r.standard_normal((PATH_ROWS + WORD_ROWS, WIDTH)) * 0.05).astype(np.float32), "dense": draw(DENSE, WIDTH), "bias": np.zeros(WIDTH, np.float32),
            "wf": draw(WIDTH, 4 * HIDDEN), "uf": draw(HIDDEN, 4 * HIDDEN), "bf": np.zeros(4 * HIDDEN, np.float32),
            "wb": draw(WIDTH, 4 * HIDDEN), "ub": draw(HIDDEN, 4 * HIDDEN), "bb": np.zeros(4 * HIDDEN, np.float32),
            "out": draw(2 * HIDDEN + WIDTH, 1), "out_bias": np.zeros(1, np.float32),
        }

    def forward(self, batch: Batch, learn: bool = True):
        p = self.p
        x = batch.embed(p["table"], p["dense"], p["bias"])
        back = batch.back[:, :, None]
        xr = np.take_along_axis(x, back, axis=1)
        hf, tape_f = lstm(x, p["wf"], p["uf"], p["bf"], learn)
        hr, tape_b = lstm(xr, p["wb"], p["ub"], p["bb"], learn)
        joint = np.concatenate([hf, np.take_along_axis(hr, back, axis=1), x], axis=2)
        return (joint @ p["out"])[:, :, 0] + p["out_bias"], (x, xr, tape_f, tape_b, joint)

    def gradients(self, batch: Batch, labels: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        z, (x, xr, tape_f, tape_b, joint) = self.forward(batch)
        dz = ((_sigmoid(z) - labels) * batch.mask / batch.mask.sum()).astype(np.float32)
        g = {"out": (joint * dz[:, :, None]).sum(axis=(0, 1))[:, None], "out_bias": dz.sum(keepdims=True)[0]}
        dj = dz[:, :, None] * p["out"][:, 0]
        back = batch.back[:, :, None]
        dxf, g["wf"], g["uf"], g["bf"] = lstm_backward(x, tape_f, dj[:, :, :HIDDEN], p["wf"], p["uf"])
        dxb, g["wb"], g["ub"], g["bb"] = lstm_backward(xr, tape_b, np.take_along_axis(dj[:, :, HIDDEN : 2 * HIDDEN], back, axis=1), p["wb"], p["ub"])
        dx = (dxf + np.take_along_axis(dxb, back, axis=1) + dj[:, :, 2 * HIDDEN :]) * (1 - x * x)
        dx = dx.reshape(-1, WIDTH)
        g["dense"], g["bias"] = batch.dense.T @ dx, dx.sum(axis=0)
        g["table"] = np.zeros_like(p["table"])
        if len(batch.cols):
            shares = dx[batch.rows[batch.by_col]] * batch.weights[batch.by_col][:, None]
            g["table"][batch.cols[batch.by_col][batch.col_starts]] = np.add.reduceat(shares, batch.col_starts, axis=0)
        return g

    def train(self, pages: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS, size: int = 40, rate: float = 0.01, seed: int = TRAIN_SEED) -> None:
        """Adam over shuffled batches of pages of like length."""
        pages = sorted(pages, key=lambda x: len(x[0]))
        batches = []
        for k in range(0, len(pages), size):
            part = pages[k : k + size]
            batch = Batch([b for b, _ in part])
            labels = np.zeros((batch.n, batch.t), dtype=np.float32)
            for i, (_, y) in enumerate(part):
                labels[i, : len(y)] = y
            batches.append((batch, labels))
        m, v = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}
        r, step = np.random.default_rng(seed), 0
        for epoch in range(epochs):
            for k in r.permutation(len(batches)):
                step += 1
                lr = rate * (1 - epoch / epochs) + 1e-4
                for name, g in self.gradients(*batches[k]).items():
                    m[name] += 0.1 * (g - m[name])
                    v[name] += 0.001 * (g * g - v[name])
                    self.p[name] -= (lr * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def main_blocks(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page a boolean per block; pages of like length share a batch."""
        found: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            longest, n = 0, 0
            while n < len(order) and max(longest, len(pages[order[n]])) * (n + 1) <= max(BATCH_BLOCKS, len(pages[order[n]])):
                longest = len(pages[order[n]])
                n += 1
            part, order = order[:n], order[n:]
            z, _ = self.forward(Batch([pages[i] for i in part]), learn=False)
            for i, row in zip(part, z):
                found[i] = row[: len(pages[i])] > 0
        return found


@lru_cache(maxsize=1)
def trained_labeller() -> Labeller:
    labeller = Labeller()
    labeller.train(labelled_pages(TRAIN_PAGES, TRAIN_SEED))
    return labeller


def main_texts(labeller: Labeller, pages: list[str | None]) -> list[str]:
    blocks = [leaf_blocks(p) for p in pages]
    return ["\n".join(b.text for b, keep in zip(own, kept) if keep) for own, kept in zip(blocks, labeller.main_blocks(blocks))]


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; one narrow map."""
    source = pages.select("page_id", "url", "html")
    kind = source.schema["page_id"].dataType.simpleString()
    labeller = trained_labeller()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = main_texts(labeller, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    return source.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
