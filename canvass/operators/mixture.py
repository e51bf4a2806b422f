"""A mixture of Gaussians with a Dirichlet process over its weights, by variational
rounds: components that the data doesn't ask for empty themselves.

A round is one pass: tasks turn their rows into sums of responsibilities, values and
products, which are added up by tree; the driver has a few numbers a component
(components x columns squared) whatever the number of rows.  The bound on the
evidence never falls and says when to stop.  Rows with a missing or non-finite value
take no part in the fit and get no component.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass import storage


def digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of the logarithm of the gamma function, for x > 0."""
    x, out = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(8):  # up to where the series is exact
        low = x < 8
        out = out - np.where(low, 1 / x, 0)
        x = x + low
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


_lgamma = np.vectorize(math.lgamma, otypes=[float])


@dataclass
class Model:
    """Of each component: the two numbers of its stick, its mean's weight and place,
    its degrees of freedom and covariance."""

    a: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    mean: np.ndarray
    freedom: np.ndarray
    covariance: np.ndarray

    def weights(self) -> np.ndarray:
        share = self.a / (self.a + self.b)
        return share * np.concatenate([[1.0], np.cumprod(1 - share)[:-1]])

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """Expected log density of rows and components together."""
        d = x.shape[1]
        sticks = digamma(self.a) - digamma(self.a + self.b)
        rest = np.concatenate([[0.0], np.cumsum(digamma(self.b) - digamma(self.a + self.b))[:-1]])
        out = np.empty((len(x), len(self.a)))
        for k, (m, c, v, beta) in enumerate(zip(self.mean, self.covariance, self.freedom, self.beta, strict=True)):
            root = np.linalg.cholesky(c)
            z = np.linalg.solve(root, (x - m).T)
            spread = digamma((v - np.arange(d)) / 2).sum() + d * np.log(2) - 2 * np.log(np.diag(root)).sum() - d * np.log(v)
            out[:, k] = 0.5 * (spread - d * np.log(2 * np.pi) - (z * z).sum(0) - d / beta) + sticks[k] + rest[k]
        return out

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        joint = self.log_joint(x)
        top = joint.max(1, keepdims=True)
        total = top + np.log(np.exp(joint - top).sum(1, keepdims=True))
        return np.exp(joint - total), total[:, 0]

    def of_parameters(self) -> float:
        """What the parameters add to the bound, up to a constant."""
        d = self.mean.shape[1]
        half_det = -0.5 * np.linalg.slogdet(self.covariance)[1] - 0.5 * d * np.log(self.freedom)
        wishart = -(self.freedom * half_det + self.freedom * d * 0.5 * np.log(2) + _lgamma((self.freedom[:, None] - np.arange(d)) / 2).sum(1))
        sticks = _lgamma(self.a) + _lgamma(self.b) - _lgamma(self.a + self.b)
        return float(-wishart.sum() + sticks.sum() - 0.5 * d * np.log(self.beta).sum())


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)


def _sums(data: DataFrame, parts) -> np.ndarray:
    """The sum of ``parts(rows)``, a vector for each batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([parts(_rows(batch))], pa.list_(pa.float64()))], ["v"])

    each = data.mapInArrow(run, "v array<double>")
    return np.array(each.agg(vector_to_array(Summarizer.sum(array_to_vector("v")))).first()[0])


def fit(rows: DataFrame, vector: str, components: int = 10, concentration: float = 0.1, ridge: float = 1e-3, rounds: int = 100, close: float = 1e-4, seed: int = 42) -> tuple[Model, list[float]]:
    """The model, and its bound after each round.  ``vector``: an array of numbers.
    Components begin at the centres of k-means, so that a run repeats itself."""
    from pyspark.ml.clustering import KMeans

    data = rows.select(F.col(vector).cast("array<double>").alias("x")).where("x IS NOT NULL AND forall(x, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity'))")
    data = storage.kept(data, "mixture")
    centres = np.array(KMeans(k=components, seed=seed, maxIter=10).fit(data.select(array_to_vector("x").alias("features"))).clusterCenters())
    k, d = len(centres), centres.shape[1]
    n, *moments = _sums(data, lambda x: np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()]))
    centre = np.array(moments[:d]) / n
    spread = np.atleast_2d(np.array(moments[d:]).reshape(d, d) / n - np.outer(centre, centre)) * n / max(n - 1, 1)

    def sums(share):
        def parts(x):
            r, total = share(x - centre)
            y = x - centre  # sums of small numbers lose less
            entropy = -(r * np.log(np.maximum(r, 1e-300))).sum()
            return np.concatenate([[entropy, total], r.sum(0), (r.T @ y).ravel(), np.einsum("nk,ni,nj->kij", r, y, y).ravel()])

        return _sums(data, parts)

    def nearest(y):
        gap = ((y[:, None, :] - (centres - centre)) ** 2).sum(2)
        return np.eye(k)[gap.argmin(1)], 0.0

    def update(s: np.ndarray) -> Model:
        size = s[2 : 2 + k] + 1e-10
        means = s[2 + k : 2 + k + k * d].reshape(k, d) / size[:, None]
        scatter = s[2 + k + k * d :].reshape(k, d, d) / size[:, None, None] - means[:, :, None] * means[:, None, :] + ridge * np.eye(d)
        after = np.concatenate([np.cumsum(size[::-1])[-2::-1], [0.0]])
        beta, freedom = 1 + size, d + size
        pull = (size / beta)[:, None, None] * means[:, :, None] * means[:, None, :]  # the prior mean is 0 here
        return Model(1 + size, concentration + after, beta, size[:, None] * means / beta[:, None], freedom, (spread + size[:, None, None] * scatter + pull) / freedom[:, None, None])

    bounds: list[float] = []
    model = update(sums(nearest))
    for _ in range(rounds):
        s = sums(lambda y, m=model: (lambda r, t: (r, t.sum()))(*m.responsibilities(y)))
        model = update(s)
        bounds.append(float(s[0]) + model.of_parameters())
        if len(bounds) > 1 and abs(bounds[-1] - bounds[-2]) < close * max(1.0, abs(bounds[-2])) * 1e-2:
            break
    model.mean = model.mean + centre
    return model, bounds


def predict(rows: DataFrame, key: str, vector: str, model: Model) -> DataFrame:
    """``key, component, probability, entropy``: the likeliest component of a row, its
    probability and how uncertain it is; nulls for a row that can't have one."""
    width = model.mean.shape[1]

    def run(batches):
        for batch in batches:
            usable = [x is not None and len(x) == width and all(v is not None and math.isfinite(v) for v in x) for x in batch.column("x").to_pylist()]
            kept = batch.filter(pa.array(usable))
            columns: list[list] = [[None] * batch.num_rows for _ in range(3)]
            if kept.num_rows:
                r, _ = model.responsibilities(_rows(kept))
                entropy = -(r * np.log(np.maximum(r, 1e-300))).sum(1)
                for i, a, b, c in zip(np.flatnonzero(usable).tolist(), r.argmax(1).tolist(), r.max(1).tolist(), entropy.tolist(), strict=True):
                    columns[0][i], columns[1][i], columns[2][i] = a, b, c
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.float64())], ["key", "component", "probability", "entropy"])

    x = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("x"))
    return x.mapInArrow(run, f"key {dict(x.dtypes)['key']}, component int, probability double, entropy double").withColumnRenamed("key", key)
