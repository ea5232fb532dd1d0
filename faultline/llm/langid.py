"""Language identification with a bidirectional gated recurrent network over bytes.

A text is read in windows of ``WINDOW`` bytes, all of it.  In each window a forward and
a backward recurrent network give a state at every byte; an output layer labels every
position, and a document's probabilities are the mean over its positions.  The gates use
the piecewise linear sigmoid clip(x, 0, 1).  Training is backpropagation through time in
numpy, on a bounded sample: about ``SAMPLE_DOCS`` documents of each language, chosen by a
hash, and ``SAMPLE_WINDOWS`` windows of each, from anywhere in the text.

Edge cases: a text that is null, empty or without a letter is ``und`` with score 0; so is
every text if there is nothing to learn from; documents without a language are not
learned from; ties go to the first language in order; repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textscan as ts

#: Bytes of a window, states of a direction, and windows that are computed at once.
WINDOW, HIDDEN, LANES = 128, 8, 2048
#: Bounds of each language's training sample, and the training itself.
SAMPLE_DOCS, SAMPLE_WINDOWS = 400, 3
EPOCHS, BATCH, RATE, SEED = 8, 128, 0.02, 11
PAD = 256
UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # 2 x 257 x 3H: gate inputs of each byte, for each direction
    recur: np.ndarray  # 2 x 2H x H: update and reset gates
    inner: np.ndarray  # 2 x H x H: candidate
    out: np.ndarray  # C x 2H
    bias: np.ndarray  # C x 1

    @classmethod
    def random(cls, languages: list[str], rng: np.random.Generator, hidden: int = HIDDEN) -> "Network":
        embed = rng.normal(0, 0.4, (2, 257, 3 * hidden))
        embed[:, :, : 2 * hidden] += 0.5
        small = lambda *shape: rng.normal(0, 0.4 / np.sqrt(hidden), shape)
        parts = (embed, small(2, 2 * hidden, hidden), small(2, hidden, hidden), small(len(languages), 2 * hidden), np.zeros((len(languages), 1)))
        return cls(languages, *(p.astype(np.float32) for p in parts))

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.recur, self.inner, self.out, self.bias]

    def states(self, windows: np.ndarray, keep: bool = False):
        """States of both directions at every position; windows: steps x lanes.  keep: also what backpropagation needs."""
        steps, lanes = windows.shape
        n = self.inner.shape[1]
        h = np.zeros((2, n, lanes), np.float32)
        both = np.empty((steps, 2, n, lanes), np.float32)
        kept = []
        x, gate, cand = (np.empty((2, k * n, lanes), np.float32) for k in (3, 2, 1))
        for t in range(steps):
            x[0], x[1] = self.embed[0][windows[t]].T, self.embed[1][windows[steps - 1 - t]].T
            np.matmul(self.recur, h, out=gate)
            gate += x[:, : 2 * n]
            raw = gate.copy() if keep else None
            np.clip(gate, 0, 1, out=gate)
            reset = gate[:, n:] * h
            np.matmul(self.inner, reset, out=cand)
            cand += x[:, 2 * n :]
            np.tanh(cand, out=cand)
            before = h
            h = cand - before
            h *= gate[:, :n]
            h += before
            both[t, 0], both[steps - 1 - t, 1] = h[0], h[1]
            if keep:
                kept.append((raw, gate.copy(), cand.copy(), before, reset))
        return (both, kept) if keep else both

    def label(self, both: np.ndarray) -> np.ndarray:
        """Probabilities at every position: steps x C x lanes."""
        steps, _, n, lanes = both.shape
        z = np.matmul(self.out, both.reshape(steps, 2 * n, lanes))
        z += self.bias
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over the positions that are not padding, and its gradients."""
        steps, lanes = windows.shape
        n = self.inner.shape[1]
        both, kept = self.states(windows, keep=True)
        p = self.label(both)
        real = (windows != PAD).astype(np.float32)
        total = max(1.0, float(real.sum()))
        loss = -float((np.log(np.maximum(p[:, target, np.arange(lanes)], 1e-9)) * real).sum()) / total
        p[:, target, np.arange(lanes)] -= 1
        p *= real[:, None] / total
        flat = both.reshape(steps, 2 * n, lanes)
        d_out, d_bias = np.einsum("tcl,thl->ch", p, flat, optimize=True), p.sum((0, 2))[:, None]
        d_both = np.matmul(self.out.T, p).reshape(steps, 2, n, lanes)
        d_embed, d_recur, d_inner = np.zeros_like(self.embed), np.zeros_like(self.recur), np.zeros_like(self.inner)
        dh = np.zeros((2, n, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            raw, gate, cand, before, reset = kept[t]
            dh[0] += d_both[t, 0]
            dh[1] += d_both[steps - 1 - t, 1]
            d_cand = dh * gate[:, :n] * (1 - cand * cand)
            d_reset = np.matmul(self.inner.transpose(0, 2, 1), d_cand)
            d_gate = np.concatenate([dh * (cand - before), d_reset * before], 1)
            d_gate *= (raw > 0) & (raw < 1)
            d_inner += np.matmul(d_cand, reset.transpose(0, 2, 1))
            d_recur += np.matmul(d_gate, before.transpose(0, 2, 1))
            dx = np.concatenate([d_gate, d_cand], 1)
            np.add.at(d_embed[0], windows[t], dx[0].T)
            np.add.at(d_embed[1], windows[steps - 1 - t], dx[1].T)
            dh = dh * (1 - gate[:, :n]) + d_reset * gate[:, n:] + np.matmul(self.recur.transpose(0, 2, 1), d_gate)
        return loss, [d_embed, d_recur, d_inner, d_out.astype(np.float32), d_bias.astype(np.float32)]


def train(windows: np.ndarray, target: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """windows: samples x WINDOW of byte values, PAD after the end.  Adam, classes weighted by sampling."""
    rng = np.random.default_rng(seed)
    net = Network.random(languages, rng)
    first, second, step = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()], 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            _, grads = net.gradients(np.ascontiguousarray(windows[rows].T), target[rows])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            rate = RATE * (1 - epoch / (epochs + 1))
            for w, g, m, v in zip(net.weights(), grads, first, second):
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def cut(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a block, window bytes x windows, and the text of each."""
    count = -(-np.diff(offsets) // window)
    text = np.repeat(np.arange(len(count)), count)
    start = offsets[text] + window * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
    at = start + np.arange(window)[:, None]
    out = np.full(at.shape, PAD, np.int16)
    inside = at < offsets[text + 1]
    out[inside] = data[at[inside]]
    return out, text


def probabilities(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean of the position probabilities of each text: texts x C."""
    windows, text = cut(data, offsets)
    total = np.zeros((len(offsets) - 1, len(net.languages)))
    for k in range(0, windows.shape[1], LANES):
        part = np.ascontiguousarray(windows[:, k : k + LANES])
        p = net.label(net.states(part))
        p *= (part != PAD)[:, None]
        summed = p.sum(0)
        for c in range(len(net.languages)):
            total[:, c] += np.bincount(text[k : k + LANES], summed[c], minlength=len(total))
    return total / np.maximum(1, np.diff(offsets))[:, None]


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Network | None:
    """Network learned from a bounded sample of the labelled documents that are not held out."""
    known = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where(F.col("l").isNotNull() & ~held_out(F.col("i")))
    sizes = known.groupBy("l").agg(F.count("*").alias("n"))
    place = F.pmod(F.xxhash64(F.col("i")), F.lit(1 << 20)) / float(1 << 20)
    share = F.least(F.lit(1.0), F.lit(float(sample_docs)) / F.col("n"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ts.string_buffers(batch.column(0))
            size = np.diff(offsets)
            seeds = batch.column(2).to_numpy().view(np.uint64)
            rows, parts = [], []
            for k in range(SAMPLE_WINDOWS):
                last = np.maximum(size - WINDOW, 0)
                start = offsets[:-1] + (ts.mix(seeds + np.uint64(k)) % (last + 1).astype(np.uint64)).astype(np.int64)
                for i in np.flatnonzero(size >= (1 if k == 0 else 2 * k * WINDOW)):
                    rows.append(i)
                    parts.append(data[start[i] : min(start[i] + WINDOW, offsets[i + 1])].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(rows, pa.int64())), pa.array(parts, pa.binary())], names=["l", "b"])

    chosen = known.join(F.broadcast(sizes), "l").where((place < share) & F.col("t").rlike(r"\p{L}")).select("t", "l", F.xxhash64("i", F.lit(1)))
    got = sorted((r.l, bytes(r.b)) for r in chosen.mapInArrow(windows, "l string, b binary").collect())
    languages = sorted({l for l, _ in got})
    if not languages:
        return None
    matrix = np.full((len(got), WINDOW), PAD, np.int16)
    for i, (_, b) in enumerate(got):
        matrix[i, : len(b)] = np.frombuffer(b, np.uint8)
    return train(matrix, np.array([languages.index(l) for l, _ in got]), languages)


def predict(docs: DataFrame, net: Network | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every document, from its whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            n = batch.num_rows
            best, score = np.zeros(n, np.int64), np.zeros(n)
            if net is not None:
                for row, data, offsets in ts.blocks(batch.column(1)):
                    p = probabilities(net, data, offsets)
                    best[row : row + len(p)] = p.argmax(1)
                    score[row : row + len(p)] = p.max(1)
            letters = batch.column(2).to_numpy(zero_copy_only=False) & (net is not None)
            names = pa.array([*(net.languages if net else []), UNKNOWN])
            picked = names.take(pa.array(np.where(letters, best, len(names) - 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), picked, pa.array(np.where(letters, np.clip(score, 0, 1), 0.0))], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(label, "doc_id long, lang_pred string, score double")
