"""Factor analysis of mixed data: numbers by their z-scores, categories by the
indicators of their levels divided by the root of the level's share, all centred.

The Gram matrix of these columns is one aggregate over sparse rows: a row touches its
numbers and one indicator a category, whatever the number of levels.  The driver has
the matrix (columns squared) and its axes; rows get their coordinates in one more
pass.  A missing number counts as the mean, a missing category is a level of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers and levels together at most.
MOST_COLUMNS = 2_000


@dataclass
class Factors:
    """Shares of variance; loadings (column by axis); what the columns are of
    (``variable, level``); means, deviations and shares."""

    shares: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    columns: list[tuple[str, str | None]]
    numbers: dict[str, tuple[float, float]]
    levels: dict[str, dict[str | None, float]]

    def sparse(self) -> tuple[F.Column, F.Column]:
        """The places of a row's columns, and their values before centring."""
        at, x = [], []
        for i, (c, (mean, sd)) in enumerate(self.numbers.items()):
            at.append(F.lit(i))
            x.append(F.coalesce((F.col(c).cast("double") - mean) / (sd or 1.0), F.lit(0.0)))
        first = len(self.numbers)
        for c, shares in self.levels.items():
            place = {k: first + i for i, k in enumerate(shares)}
            first += len(shares)
            # A level name that no value has stands for null.
            key = F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
            table = lambda of: F.element_at(F.create_map(*(F.lit(v) for k, s in shares.items() for v in ("" if k is None else f"={k}", of(k, s)))), key)  # noqa: E731, B023
            at.append(table(lambda k, s: place[k]))  # noqa: B023
            x.append(table(lambda k, s: float(s) ** -0.5))
        return F.array(*at), F.array(*x)

    def centre(self) -> np.ndarray:
        return np.concatenate([np.zeros(len(self.numbers)), *(np.sqrt(list(s.values())) for s in self.levels.values())])


def _gram(width: int):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                at = np.asarray(batch.column("at").flatten()).reshape(n, -1)
                x = np.asarray(batch.column("x").flatten()).reshape(n, -1)
                pairs = (at[:, :, None] * width + at[:, None, :]).ravel()
                total = np.bincount(pairs, (x[:, :, None] * x[:, None, :]).ravel(), width * width)
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])

    return run


def fit(rows: DataFrame, numbers: list[str], categories: list[str], components: int = 5) -> Factors:
    """The first axes; an axis points the way that makes its largest loading positive."""
    names = [c for c in numbers for _ in range(2)]
    stats = rows.agg(F.count("*").alias("n"), *(f(c).alias(f"{i}") for i, (c, f) in enumerate(zip(names, (F.avg, F.stddev_pop) * len(numbers), strict=True)))).first()
    # All categories in one pass; a row a level.
    long = rows.select(F.inline(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in categories)))) if categories else None
    counts = long.groupBy("variable", "level").count().limit(MOST_COLUMNS + 1).collect() if categories else []
    if len(counts) + len(numbers) > MOST_COLUMNS:
        raise ValueError(f"over {MOST_COLUMNS} columns")
    if not stats.n:
        raise ValueError("no rows")
    found: dict[str, dict[str | None, float]] = {c: {} for c in categories}
    for r in sorted(counts, key=lambda r: (r.variable, r.level is not None, r.level or "")):
        found[r.variable][r.level] = r["count"] / stats.n
    columns = [(c, None) for c in numbers] + [(c, k) for c in categories for k in found[c]]
    out = Factors(np.zeros(0), np.zeros(0), np.zeros((0, 0)), columns, {c: (float(stats[2 * i + 1] or 0), float(stats[2 * i + 2] or 0)) for i, c in enumerate(numbers)}, found)
    at, x = out.sparse()
    width = len(columns)
    sums = rows.select(at.alias("at"), x.alias("x")).mapInArrow(_gram(width), "v array<double>")
    raw = np.array(sums.agg(vector_to_array(Summarizer.sum(array_to_vector("v")))).first()[0]).reshape(width, width) / stats.n
    centre = out.centre()
    values, axes = np.linalg.eigh(raw - np.outer(centre, centre))
    order = np.argsort(-values, kind="stable")[: min(components, width)]
    out.axes = axes[:, order] * np.sign(axes[np.abs(axes[:, order]).argmax(0), order])
    out.values, out.shares = values[order], values[order] / values.sum()
    return out


def coordinates(rows: DataFrame, key: str, factors: Factors) -> DataFrame:
    """``key, f0, f1, ...``: where each row lies on the axes."""
    at, x = factors.sparse()
    k = factors.axes.shape[1]
    shift = factors.centre() @ factors.axes
    out = rows.select(key, F.arrays_zip(at.alias("at"), x.alias("x")).alias("cells"))

    def on_axis(j: int) -> F.Column:
        loadings = F.array(*(F.lit(float(v)) for v in factors.axes[:, j]))
        return F.aggregate("cells", F.lit(-float(shift[j])), lambda s, c: s + c["x"] * F.element_at(loadings, c["at"] + 1))

    for j in range(k):
        out = out.withColumn(f"f{j}", on_axis(j))
    return out.select(key, *(f"f{j}" for j in range(k)))


def contributions(factors: Factors) -> list[tuple[str, int, float]]:
    """Of each variable and axis the share that its columns have in the axis."""
    out: dict[tuple[str, int], float] = {}
    for (c, _), row in zip(factors.columns, factors.axes, strict=True):
        for j, v in enumerate(row):
            out[c, j] = out.get((c, j), 0.0) + float(v * v)
    return [(c, j, v) for (c, j), v in out.items()]
