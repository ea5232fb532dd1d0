"""A learned trace scorer: a variational autoencoder of service vectors in numpy, and its likelihood by importance sampling.

A vector's present dimensions are given by a mask; only these count.  Training reads a
bounded sample of normal traces (``SAMPLE``, chosen by a hash of the trace); scoring runs
on all traces, in Arrow batches, with the weights broadcast (their size is the number of
dimensions times ``HIDDEN``, which is checked).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Traces of the training sample, hidden and latent units, passes, batch, step size, least improvement and patience, samples of the likelihood, greatest number of dimensions.
SAMPLE, HIDDEN, LATENT, EPOCHS, BATCH, RATE, PATIENCE, SAMPLES, MOST_DIMS, SEED = 4096, 32, 4, 60, 128, 0.005, 8, 32, 1 << 16, 17
#: Rows that are scored at once.
SCORED = 256
LOG_2PI = math.log(2 * math.pi)


def soft(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


@dataclass
class Model:
    """Weights: x -> hidden -> (mean, log variance) of z; z -> hidden -> (mean, log variance) of x."""

    weights: list[np.ndarray]

    @classmethod
    def random(cls, dims: int, rng: np.random.Generator, hidden: int = HIDDEN, latent: int = LATENT) -> "Model":
        make = lambda a, b: [rng.normal(0, 1 / math.sqrt(a), (a, b)), np.zeros(b)]
        return cls([*make(dims, hidden), *make(hidden, 2 * latent), *make(latent, hidden), *make(hidden, 2 * dims)])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w1, b1, w2, b2 = self.weights[:4]
        h = np.tanh(x @ w1 + b1)
        out = h @ w2 + b2
        k = out.shape[1] // 2
        return h, out[:, :k], np.clip(out[:, k:], -10, 10)

    def decode(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w3, b3, w4, b4 = self.weights[4:]
        h = np.tanh(z @ w3 + b3)
        out = h @ w4 + b4
        k = out.shape[1] // 2
        return h, out[:, :k], out[:, k:]

    def step(self, x: np.ndarray, mask: np.ndarray, eps: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Negative evidence bound per row, and its gradients.  The decoder's variance is 1e-4 + softplus."""
        _, _, w2, _, w3, _, w4, _ = self.weights
        n = len(x)
        h1, mu, logvar = self.encode(x)
        std = np.exp(0.5 * logvar)
        z = mu + eps * std
        h2, mean, raw = self.decode(z)
        var = 1e-4 + soft(raw)
        gap = x - mean
        loss = 0.5 * (mask * (LOG_2PI + np.log(var) + gap * gap / var)).sum() - 0.5 * (1 + logvar - mu * mu - np.exp(logvar)).sum()
        d_mean = -mask * gap / var / n
        d_raw = 0.5 * mask * (1 / var - gap * gap / (var * var)) / (1 + np.exp(-raw)) / n
        d_out = np.concatenate([d_mean, d_raw], 1)
        d_h2 = (d_out @ w4.T) * (1 - h2 * h2)
        d_z = d_h2 @ w3.T
        inside = np.abs(logvar) < 10
        d_code = np.concatenate([d_z + mu / n, inside * (0.5 * d_z * eps * std + 0.5 * (np.exp(logvar) - 1) / n)], 1)
        d_h1 = (d_code @ w2.T) * (1 - h1 * h1)
        return loss / n, [x.T @ d_h1, d_h1.sum(0), h1.T @ d_code, d_code.sum(0), z.T @ d_h2, d_h2.sum(0), h2.T @ d_out, d_out.sum(0)]

    def log_likelihood(self, x: np.ndarray, mask: np.ndarray, rng: np.random.Generator, samples: int = SAMPLES) -> np.ndarray:
        """log p(x) of each row: mean weight of samples from the encoder."""
        _, mu, logvar = self.encode(x)
        std = np.exp(0.5 * logvar)
        logs = []
        for _ in range(samples):
            eps = rng.normal(size=mu.shape)
            z = mu + eps * std
            _, mean, raw = self.decode(z)
            var = 1e-4 + soft(raw)
            log_px = -0.5 * (mask * (LOG_2PI + np.log(var) + (x - mean) ** 2 / var)).sum(1)
            logs.append(log_px - 0.5 * (LOG_2PI + z * z).sum(1) + 0.5 * (LOG_2PI + logvar + eps * eps).sum(1))
        stacked = np.stack(logs)
        top = stacked.max(0)
        return top + np.log(np.exp(stacked - top).mean(0))

    def log_likelihoods(self, counts: np.ndarray, dims: np.ndarray, values: np.ndarray, eps: np.ndarray) -> np.ndarray:
        """log_likelihood() of many rows at once from their present dimensions only; counts: dimensions of each row; eps: rows x samples x latent units.

        Sums go unit by unit over whole arrays, not through BLAS, so that a row's result does
        not depend on the rows beside it.
        """
        w1, b1, w2, b2, w3, b3, w4, b4 = self.weights
        n, samples, latent = eps.shape
        width, row = w4.shape[1] // 2, np.repeat(np.arange(n), counts)
        some = np.flatnonzero(counts)
        starts = (np.cumsum(counts) - counts)[some]

        def by_row(x: np.ndarray) -> np.ndarray:
            """Sums over the dimensions of each row, along the last axis."""
            out = np.zeros((*x.shape[:-1], n))
            if len(some):
                out[..., some] = np.add.reduceat(x, starts, axis=-1)
            return out

        h = np.tanh(np.stack([by_row(values * w1[dims, k]) for k in range(w1.shape[1])]) + b1[:, None])
        code = np.zeros((2 * latent, n)) + b2[:, None]
        for k in range(len(h)):
            code += h[k] * w2[k][:, None]
        mu, logvar = code[:latent], np.clip(code[latent:], -10, 10)
        std = np.exp(0.5 * logvar)
        noise = np.ascontiguousarray(eps.transpose(2, 1, 0))
        z = mu[:, None] + noise * std[:, None]
        mean, raw = np.zeros((samples, len(dims))) + b4[dims], np.zeros((samples, len(dims))) + b4[width + dims]
        for k in range(w3.shape[1]):
            unit = np.full((samples, n), b3[k])
            for j in range(latent):
                unit += z[j] * w3[j, k]
            unit = np.tanh(unit)[:, row]
            mean += unit * w4[k, dims]
            raw += unit * w4[k, width + dims]
        var = 1e-4 + soft(raw)
        logs = -0.5 * by_row(LOG_2PI + np.log(var) + (values - mean) ** 2 / var)
        for j in range(latent):
            logs += 0.5 * (logvar[j] + noise[j] * noise[j] - z[j] * z[j])
        top = logs.max(0)
        total = np.zeros(n)
        for k in range(samples):
            total += np.exp(logs[k] - top)
        return top + np.log(total / samples)


def train(x: np.ndarray, mask: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Adam with early stop on a tenth of the rows that is held out; the best weights are kept."""
    rng = np.random.default_rng(seed)
    model = Model.random(x.shape[1], rng)
    valid = np.arange(len(x)) % 10 == 9 if len(x) >= 20 else np.zeros(len(x), bool)
    rows = np.flatnonzero(~valid)
    first, second, step = [np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights], 0
    best, kept, waited = math.inf, [w.copy() for w in model.weights], 0
    for epoch in range(epochs):
        order = rng.permutation(rows)
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            _, grads = model.step(x[part], mask[part], rng.normal(size=(len(part), LATENT)))
            norm = math.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            for w, g, m, v in zip(model.weights, grads, first, second):
                g = g * min(1.0, 5 / max(norm, 1e-9))
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        test = valid if valid.any() else ~valid
        loss, _ = model.step(x[test], mask[test], np.zeros((int(test.sum()), LATENT)))
        if loss < best - 1e-4:
            best, kept, waited = loss, [w.copy() for w in model.weights], 0
        else:
            waited += 1
            if waited >= PATIENCE:
                break
    return Model(kept)


def matrices(dims: pa.Array, values: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Dense vectors and masks of list columns of dimensions and normalized values."""
    rows = np.repeat(np.arange(len(dims)), dims.value_lengths().to_numpy(zero_copy_only=False).astype(int))
    at = dims.flatten().to_numpy(zero_copy_only=False).astype(int)
    x, mask = np.zeros((len(dims), width)), np.zeros((len(dims), width))
    x[rows, at], mask[rows, at] = values.flatten().to_numpy(zero_copy_only=False), 1
    return x, mask


def present(dims: pa.Array, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of dimensions of each row, and all rows' dimensions and values; of an equal dimension's values in a row the last counts, as in matrices()."""
    counts = dims.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row, at = np.repeat(np.arange(len(counts)), counts), dims.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    keep = np.ones(len(at), bool)
    keep[:-1] = (row[1:] != row[:-1]) | (at[1:] != at[:-1])
    return np.bincount(row[keep], minlength=len(counts)), at[keep], values.flatten().to_numpy(zero_copy_only=False).astype(float)[keep]


def normalized(vectors: DataFrame, stats: DataFrame) -> DataFrame:
    """One row a trace: known dimensions in order, and their values in deviations from the mean, rounded so that the order of sums has no influence."""
    z = F.round((F.col("duration") - F.col("mean")) / F.col("sigma"), 6)
    known = vectors.where("dim is not null").join(stats, "dim").select("trace_id", F.struct("dim", z.alias("z")).alias("x"))
    return known.groupBy("trace_id").agg(F.array_sort(F.collect_list("x")).alias("x")).select("trace_id", F.col("x.dim").alias("dims"), F.col("x.z").alias("values"))


def fit(rows: DataFrame, width: int, sample: int = SAMPLE, epochs: int = EPOCHS) -> Model:
    """Model of (a bounded sample of) normalized rows."""
    if width > MOST_DIMS:
        raise ValueError(f"{width} dimensions are more than {MOST_DIMS}")
    chosen = rows.orderBy(F.xxhash64("trace_id"), "trace_id").limit(sample).select("dims", "values").toArrow().combine_chunks()
    dims, values = (chosen.column(c).combine_chunks() for c in ("dims", "values"))
    x, mask = matrices(dims, values, width)
    return train(x, mask, epochs)


def likelihoods(rows: DataFrame, model: Model, width: int, samples: int = SAMPLES) -> DataFrame:
    """trace_id and score: log-likelihood by the number of known dimensions.  Each trace has its own random numbers, so partitioning has no influence."""
    shared = rows.sparkSession.sparkContext.broadcast(model.weights)
    kind = rows.schema["trace_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        latent = model.weights[4].shape[0]
        for batch in batches:
            out = []
            for k in range(0, batch.num_rows, SCORED):
                part = batch.slice(k, SCORED)
                counts, dims, values = present(part.column(1), part.column(2))
                eps = np.stack([np.random.default_rng(s & 0xFFFFFFFF).normal(size=(samples, latent)) for s in part.column(3).to_pylist()])
                out.append(model.log_likelihoods(counts, dims, values, eps) / np.maximum(1, counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["trace_id", "score"])

    # by number, so that adaptive execution does not merge the small rows into a few tasks
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "trace_id")
    return rows.select("trace_id", "dims", "values", F.xxhash64("trace_id")).mapInArrow(score, f"trace_id {kind}, score double")


def as_table(spark: SparkSession, model: Model) -> DataFrame:
    """Weights as rows (number, shape, values), to be stored as Parquet."""
    return spark.createDataFrame([(i, list(w.shape), w.ravel().tolist()) for i, w in enumerate(model.weights)], "number int, shape array<int>, values array<double>")


def from_table(rows: DataFrame) -> Model:
    """The model of stored weights (a row each)."""
    return Model([np.array(r["values"]).reshape(r["shape"]) for r in rows.orderBy("number").collect()])
