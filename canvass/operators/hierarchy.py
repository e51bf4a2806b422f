"""Hierarchical logistic models: an effect for each of many groups around a shared
mean, shared effects of factors' levels, and slopes.

The posterior mode is found by Newton steps on a Hessian of arrow shape.  A group's
own block is one number and one row of the shared effects' length, summed by group;
what is left when the groups are eliminated is a system of the shared effects alone,
which the driver solves.  The spread of the group effects is estimated along the way
(an EM step with a half-normal prior).  A step is one pass over the rows, which sums
within batches before it groups, and one over the groups.

Rows without an outcome or a group are left out; a missing level has no effect, a
missing number counts as the mean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass import storage

#: Shared effects that the driver's system may have.
MOST_SHARED = 2_000


def _sums(width: int, theta: np.ndarray):
    """Of each batch: a row a group (weights, residuals, weighted shared columns),
    and one without a group (gradient and Hessian of the shared effects)."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at = np.asarray(batch.column("at").flatten()).reshape(n, -1)
            x = np.asarray(batch.column("x").flatten()).reshape(n, -1)
            eta = (theta[at] * x).sum(1) + np.asarray(batch.column("effect"))
            p = 1 / (1 + np.exp(-eta))
            w, e = p * (1 - p), np.asarray(batch.column("y")) - p
            names, group = np.unique(np.asarray(batch.column("group")), return_inverse=True)
            g = len(names)
            own = np.zeros((g, width + 2))
            own[:, 0], own[:, 1] = np.bincount(group, w, g), np.bincount(group, e, g)
            cells = (group[:, None] * width + at).ravel()
            own[:, 2:] = np.bincount(cells, (w[:, None] * x).ravel(), g * width).reshape(g, width)
            gradient = np.bincount(at.ravel(), (e[:, None] * x).ravel(), width)
            pairs = (at[:, :, None] * width + at[:, None, :]).ravel()
            hessian = np.bincount(pairs, (w[:, None, None] * x[:, :, None] * x[:, None, :]).ravel(), width * width)
            values = [*own, np.concatenate([gradient, hessian])]
            yield pa.RecordBatch.from_arrays([pa.array([*names.tolist(), None], pa.int64()), pa.array(values, pa.list_(pa.float64()))], ["group", "v"])

    return run


def _total(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    return rows.groupBy(*by).agg(vector_to_array(Summarizer.sum(array_to_vector(F.col(column)))).alias(column))


def _shared(rows: DataFrame, factors: dict[str, float], slopes: dict[str, float], intercept: tuple[float, float]):
    """Names, prior means and deviations of the shared effects, and the columns
    ``at`` and ``x``: the places and values of those of a row that aren't zero."""
    names, mean, sd = ["intercept"], [intercept[0]], [intercept[1]]
    at, x = [F.lit(0)], [F.lit(1.0)]
    for factor, spread in factors.items():
        levels = sorted(r[0] for r in rows.select(F.col(factor).cast("string")).where(F.col(factor).isNotNull()).distinct().limit(MOST_SHARED + 1).collect())
        if len(names) + len(levels) > MOST_SHARED:
            raise ValueError(f"over {MOST_SHARED} shared effects; make {factor} a group")
        code = F.element_at(F.create_map(*(F.lit(v) for k, level in enumerate(levels) for v in (level, len(names) + k))), F.col(factor).cast("string")) if levels else F.lit(None)
        at.append(F.coalesce(code, F.lit(0)))
        x.append(F.when(code.isNotNull(), 1.0).otherwise(0.0))
        names += [f"{factor}[{level}]" for level in levels]
        mean += [0.0] * len(levels)
        sd += [spread] * len(levels)
    if slopes:
        stats = rows.agg(*(f(c).alias(f"{n}_{c}") for c in slopes for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        for c, spread in slopes.items():
            at.append(F.lit(len(names)))
            x.append(F.coalesce((F.col(c).cast("double") - float(stats[f"m_{c}"] or 0)) / float(stats[f"s_{c}"] or 1), F.lit(0.0)))
            names.append(c)
            mean.append(0.0)
            sd.append(spread)
    return names, np.array(mean), np.array(sd), F.array(*at).alias("at"), F.array(*x).alias("x")


def _columns(group: str, factors: dict[str, float], slopes: dict[str, float]) -> list[str]:
    return list(dict.fromkeys([group, *factors, *slopes]))


def fit(rows: DataFrame, outcome: str, group: str, factors: dict[str, float], slopes: dict[str, float], **settings) -> DataFrame:
    """``kind, name, mean, sd``: the shared effects ('shared'), the groups' spread
    ('spread'), and each group's own level ('group': the intercept and its effect).
    ``factors`` and ``slopes`` give the prior deviations of their effects; numbers
    are standardised.  ``group`` is of an integer type."""
    rows = storage.kept(rows.select(*dict.fromkeys([outcome, *_columns(group, factors, slopes)])), "observed")
    return _fit(rows, outcome, group, factors, slopes, **settings)


def _fit(rows: DataFrame, outcome: str, group: str, factors: dict[str, float], slopes: dict[str, float], intercept: tuple[float, float] = (-3.0, 1.0), spread: float = 0.5, rounds: int = 40, close: float = 1e-5) -> DataFrame:
    """``fit`` of rows that are written already, as they are read several times."""
    rows = rows.where(F.col(outcome).isNotNull() & F.col(group).isNotNull())
    names, mean, sd, at, x = _shared(rows, factors, slopes, intercept)
    k, precision = len(names), np.diag(1 / sd**2)
    # Dealt out and sorted by group once: a step moves the groups' effects to the
    # rows, and what a batch sums up is a row for each of a few groups.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    data = rows.select(F.col(group).cast("long").alias("group"), F.col(outcome).cast("double").alias("y"), at, x).repartition(n, "group").sortWithinPartitions("group").persist(StorageLevel.DISK_ONLY)
    data.count()
    effects = storage.kept(data.groupBy("group").agg(F.lit(0.0).alias("effect")), "effects")
    groups, rate = effects.count(), data.agg(F.avg("y")).first()[0] or 0.5
    theta, variance, covariance = np.zeros(k), spread**2, np.diag(sd**2)
    theta[0] = np.log((rate + 1e-6) / (1 - rate + 1e-6))
    array = lambda v: F.array(*(F.lit(float(a)) for a in v))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    for _ in range(rounds):
        summed = storage.kept(_total(data.join(effects, "group").select("group", "effect", "y", "at", "x").mapInArrow(_sums(k, theta), "group long, v array<double>"), ["group"], "v"), "sums")
        own = summed.where("group IS NOT NULL").join(effects, "group")
        # The group's block: curvature, gradient, and its row of shared columns.
        a, r, c = F.col("v")[0] + 1 / variance, F.col("v")[1] - F.col("effect") / variance, F.slice("v", 3, k)
        own = own.select("group", "effect", a.alias("a"), r.alias("r"), c.alias("c"))
        spread_now = F.col("effect") * F.col("effect") + 1 / F.col("a")
        outer = F.flatten(F.transform("c", lambda u: F.transform("c", lambda v: u * v / F.col("a"))))
        ratio = F.transform("c", lambda u: u / F.col("a"))
        # The groups' effects also vary with the shared ones: the last k * k numbers say how.
        twice = F.flatten(F.transform(ratio, lambda p: F.transform(ratio, lambda q: p * q)))
        left = _total(own.select(F.concat(F.array(spread_now), F.transform("c", lambda u: u * F.col("r") / F.col("a")), outer, twice).alias("v")), [], "v")
        both = left.join(F.broadcast(summed.where("group IS NULL").select(F.col("v").alias("whole"))), F.lit(True)).first()  # a row each
        gone, second, whole = np.array(both.v[: 1 + k + k * k]), np.array(both.v[1 + k + k * k :]), np.array(both.whole)
        gradient = whole[:k] - precision @ (theta - mean) - gone[1 : 1 + k]
        system = whole[k:].reshape(k, k) + precision - gone[1 + k :].reshape(k, k)
        covariance = np.linalg.inv(system)
        step = covariance @ gradient
        part = min(1.0, 1.0 / max(np.abs(step).max(), 1e-300))  # far off, the curvature says little
        theta = theta + part * step
        moved = own.withColumn("change", (F.col("r") - dot(F.col("c"), array(step))) * part / F.col("a"))
        effects = storage.kept(moved.select("group", (F.col("effect") + F.col("change")).alias("effect"), "a", "c"), "effects")
        q = gone[0] + (second.reshape(k, k) * covariance).sum()
        before, variance = variance, (np.sqrt(groups**2 + 4 * q / spread**2) - groups) * spread**2 / 2
        if max(np.abs(step).max(), abs(variance - before)) < close:
            break
    data.unpersist()
    # A group's level varies by itself and with the shared effects: e is the intercept's place.
    shift = F.zip_with(F.transform("c", lambda u: -u / F.col("a")), array(np.eye(k)[0]), lambda u, e: u + e)
    varied = lambda v: dot(v, F.array(*(dot(v, array(row)) for row in covariance)))
    levels = effects.select(F.lit("group").alias("kind"), F.col("group").cast("string").alias("name"), (F.col("effect") + float(theta[0])).alias("mean"), F.sqrt(1 / F.col("a") + varied(shift)).alias("sd"))
    shared = [("shared", n, float(m), float(s)) for n, m, s in zip(names, theta, np.sqrt(np.diag(covariance)), strict=True)] + [("spread", group, float(np.sqrt(variance)), None)]
    return rows.sparkSession.createDataFrame(shared, "kind string, name string, mean double, sd double").unionByName(levels)


def two_stages(rows: DataFrame, opened: str, clicked: str, group: str, factors: dict[str, float], slopes: dict[str, float], **settings) -> DataFrame:
    """Opening by all rows, and clicking by those that were opened, each with its
    own effects: ``stage`` before the columns of ``fit``."""
    rows = storage.kept(rows.select(*dict.fromkeys([opened, clicked, *_columns(group, factors, slopes)])), "observed")
    first = _fit(rows, opened, group, factors, slopes, intercept=(-3.0, 1.0), **settings)
    second = _fit(rows.where(F.col(opened)), clicked, group, factors, slopes, intercept=(-2.5, 1.0), **settings)
    return first.select(F.lit("open").alias("stage"), "*").unionByName(second.select(F.lit("click").alias("stage"), "*"))
