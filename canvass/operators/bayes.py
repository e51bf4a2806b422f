"""Bayesian click models: posterior mode from sums over all rows, chains of a
sampler in parallel, and what is read off the draws."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions import values as V


def logistic_map(rows: DataFrame, outcome: str, features: list[str], intercept=(0.0, 2.0), slope=(0.0, 1.0), rounds: int = 25) -> DataFrame:
    """Posterior mode and Laplace standard deviation of a logistic model with
    normal priors (mean, sd).  Features are standardised by their population
    deviation.  Every Newton step is one aggregate over all rows; a vector and a
    matrix of the features' number come to the driver."""
    stats = rows.agg(*(f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    x = [F.lit(1.0), *((F.col(c) - float(stats[f"m_{c}"] or 0)) / float(stats[f"s_{c}"] or 1.0) for c in features)]
    k = len(x)
    base = rows.select(F.col(outcome).cast("double").alias("y"), *(c.alias(f"x{i}") for i, c in enumerate(x))).dropna().cache()
    mean = np.array([intercept[0]] + [slope[0]] * (k - 1))
    precision = np.diag(1 / np.array([intercept[1]] + [slope[1]] * (k - 1)) ** 2)
    w, hessian = mean.copy(), precision
    for _ in range(rounds):
        p = V.logistic(sum((F.col(f"x{i}") * float(w[i]) for i in range(k)), F.lit(0.0)))
        sums = [F.sum((F.col("y") - p) * F.col(f"x{i}")).alias(f"g{i}") for i in range(k)]
        sums += [F.sum(p * (1 - p) * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        r = base.agg(*sums).first()
        slope_ = np.array([r[f"g{i}"] or 0.0 for i in range(k)]) - precision @ (w - mean)
        hessian = precision + np.array([[r[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        step = np.linalg.solve(hessian, slope_)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    base.unpersist()
    sd = np.sqrt(np.diag(np.linalg.inv(hessian)))
    names = ["intercept", *features]
    out = [(n, round(float(a), 8), round(float(b), 8), round(float(np.exp(a)), 8), bool((a - 1.96 * b) * (a + 1.96 * b) > 0)) for n, a, b in zip(names, w, sd, strict=True)]
    return rows.sparkSession.createDataFrame(out, "param string, mean double, sd double, odds_ratio double, credible boolean")


def sample_chains(grouped: DataFrame, k: int, prior_mean: list[float], prior_sd: list[float], chains: int = 4, draws: int = 1000, tune: int = 500, seed: int = 42) -> DataFrame:
    """Draws of a logistic model's posterior, a chain a task: model rows are
    ``x array<double>, n, successes``, grouped first so that they are few.
    Returns chain, draw, param, value.  Random-walk steps scaled by the mode's
    curvature."""
    data = [(list(r["x"]), float(r["n"]), float(r["successes"])) for r in grouped.select("x", "n", "successes").collect()]
    x, n, s = np.array([d[0] for d in data]), np.array([d[1] for d in data]), np.array([d[2] for d in data])
    m, sd = np.array(prior_mean), np.array(prior_sd)

    def run(pdf):
        import pandas as pd

        chain = int(pdf["chain"].iloc[0])
        rng = np.random.default_rng(seed + chain)

        def logp(b):
            e = x @ b
            return float((s * e - n * np.logaddexp(0, e)).sum() - (((b - m) / sd) ** 2).sum() / 2)

        b = m.copy()
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ b))
            h = x.T @ (x * (n * p * (1 - p))[:, None]) + np.diag(1 / sd**2)
            b = b + np.linalg.solve(h, x.T @ (s - n * p) - (b - m) / sd**2)
        root = np.linalg.cholesky(np.linalg.inv(h)) * 2.38 / np.sqrt(k)
        b = b + root @ rng.standard_normal(k)
        now, out = logp(b), []
        for t in range(draws + tune):
            c = b + root @ rng.standard_normal(k)
            new = logp(c)
            if np.log(rng.random()) < new - now:
                b, now = c, new
            if t >= tune:
                out.append(b)
        out = np.array(out)
        return pd.DataFrame({"chain": chain, "draw": np.repeat(np.arange(draws), k), "param": np.tile(np.arange(k), draws), "value": out.ravel()})

    spark = grouped.sparkSession
    return spark.range(chains).select(F.col("id").cast("int").alias("chain")).groupBy("chain").applyInPandas(run, "chain int, draw int, param int, value double")


def effective_size(draws: DataFrame, value: str = "value", chain: str = "chain", draw: str = "draw", by: str = "param") -> DataFrame:
    """Per parameter the effective number of draws, by the initial positive
    sequence of autocorrelations; a parameter's draws are one bounded group."""

    def run(pdf):
        import pandas as pd

        x = pdf.sort_values([chain, draw])[value].to_numpy().reshape(pdf[chain].nunique(), -1)
        m, n = x.shape
        c = x - x.mean(axis=1, keepdims=True)
        f = np.fft.rfft(c, 2 * n)
        acov = np.fft.irfft(f * np.conj(f))[:, :n].mean(axis=0) / n
        w = acov[0] * n / (n - 1)
        var = w * (n - 1) / n + (x.mean(axis=1).var(ddof=1) if m > 1 else 0)
        rho = 1 - (w - acov * n / (n - 1)) / var
        total, t = -1.0, 0
        while t + 1 < n and rho[t] + rho[t + 1] > 0:
            total += 2 * (rho[t] + rho[t + 1])
            t += 2
        return pd.DataFrame({by: [pdf[by].iloc[0]], "ess": [m * n / max(total, 1e-9)]})

    return draws.groupBy(by).applyInPandas(run, f"{by} int, ess double")


def predict_segments(segments: DataFrame, draws: DataFrame) -> DataFrame:
    """Rate of each segment over the posterior: ``segments`` has segment and x
    (array, the intercept's 1 first); draws are long.  Returns segment, draw,
    chain, rate."""
    wide = draws.groupBy("chain", "draw").agg(F.sort_array(F.collect_list(F.struct("param", "value"))).alias("b"))
    # Segments are a handful of literal rows.
    both = wide.join(F.broadcast(segments), F.lit(True))
    eta = F.aggregate(F.zip_with("x", F.col("b.value"), lambda x, b: x * b), F.lit(0.0), lambda a, v: a + v)
    return both.select("segment", "chain", "draw", V.logistic(eta).alias("rate"))


def waic(pointwise: DataFrame, point: str, log_lik: str) -> DataFrame:
    """elpd and effective parameters from log-likelihoods per point and draw;
    the model with the higher elpd is the better one."""
    # log-mean-exp around each point's maximum
    rows = pointwise.select(F.col(point).alias("point"), F.col(log_lik).alias("l"))
    top = rows.groupBy("point").agg(F.max("l").alias("top"))
    per = rows.join(top, "point").groupBy("point").agg(F.max("top").alias("top"), F.avg(F.exp(F.col("l") - F.col("top"))).alias("mean"), F.var_samp("l").alias("p"))
    return per.agg(F.sum(F.log("mean") + F.col("top") - F.col("p")).alias("elpd"), F.sum("p").alias("p_waic"), F.count("*").alias("points"))


def tail_shape(excess: np.ndarray) -> tuple[float, float]:
    """Shape and scale of the generalised Pareto distribution of sorted positive
    numbers: the posterior mean over a grid, drawn weakly towards a shape of 0.5."""
    n = len(excess)
    grid = 30 + int(np.sqrt(n))
    b = 1 / excess[-1] + (1 - np.sqrt(grid / (np.arange(1, grid + 1) - 0.5))) / (3 * excess[int(n / 4 + 0.5) - 1])
    shapes = np.log1p(-b[:, None] * excess).mean(1)
    fit = n * (np.log(-b / shapes) - shapes - 1)
    weight = 1 / np.exp(np.clip(fit[None, :] - fit[:, None], -700, 700)).sum(1)
    best = (b * weight).sum() / weight.sum()
    shape = np.log1p(-best * excess).mean()
    return (n * shape + 5) / (n + 10), -shape / best


def smoothed_weights(log_lik: np.ndarray) -> tuple[np.ndarray, float]:
    """Log weights, normalised, that turn draws given all observations into draws
    given all but this one, their largest fifth (or 3 * sqrt(n)) smoothed by the tail
    fitted to them; and the tail's shape: over 0.7 the result isn't to be trusted."""
    raw = -log_lik - (-log_lik).max()
    n = len(raw)
    many = int(min(0.2 * n, 3 * np.sqrt(n)))
    order = np.argsort(raw, kind="stable")
    shape = np.inf
    if many >= 5:
        tail, cut = order[-many:], np.exp(raw[order[-many - 1]])
        excess = np.exp(raw[tail]) - cut
        if excess[0] <= 0 or excess[-1] - excess[0] < 1e-12 * cut:
            shape = 0.0 if excess[-1] < 1e-12 else shape  # nothing to smooth
        else:
            shape, scale = tail_shape(excess)
            at = (np.arange(many) + 0.5) / many
            raw[tail] = np.minimum(np.log(cut + (scale * np.expm1(-shape * np.log1p(-at)) / shape if abs(shape) > 1e-12 else -scale * np.log1p(-at))), 0)
    top = raw.max()
    return raw - top - np.log(np.exp(raw - top).sum()), float(shape)


def loo(pointwise: DataFrame, point: list[str], log_lik: str) -> DataFrame:
    """``*point, elpd, k``: the expected log density of each observation given the
    others, by Pareto-smoothed importance weights, and the tail's shape.  The draws
    of one observation are one group, as many as there are draws."""

    def run(pdf):
        import pandas as pd

        l = pdf["_l"].to_numpy(float)
        w, k = smoothed_weights(l)
        joint = w + l
        out = {c: [pdf[c].iloc[0]] for c in point}
        return pd.DataFrame(out | {"elpd": [joint.max() + np.log(np.exp(joint - joint.max()).sum())], "k": [k]})

    rows = pointwise.select(*point, F.col(log_lik).cast("double").alias("_l")).where("_l IS NOT NULL")
    schema = ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes[:-1]), "elpd double, k double"])
    return rows.groupBy(*point).applyInPandas(run, schema)


def loo_rows(rows: DataFrame, keep: list[str], log_lik: str) -> DataFrame:
    """``*keep, elpd, k`` as ``loo`` has them, a row an observation whose column
    ``log_lik`` holds its log-likelihoods in all draws as an array: nothing is shuffled."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            found = []
            for l in batch.column("_l").to_numpy(zero_copy_only=False):
                w, k = smoothed_weights(l)
                joint = w + l
                found.append((joint.max() + np.log(np.exp(joint - joint.max()).sum()), k))
            values = np.array(found, float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values[:, 0]), pa.array(values[:, 1])], [*keep, "elpd", "k"])

    given = F.filter(F.col(log_lik).cast("array<double>"), lambda v: v.isNotNull())
    rows = rows.select(*keep, given.alias("_l")).where("size(_l) > 0")
    schema = ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes[:-1]), "elpd double, k double"])
    return rows.mapInArrow(run, schema)


def loo_total(each: DataFrame, model: str) -> DataFrame:
    """``model, elpd, se, worst_k, unsure``: sums over observations, the standard
    error of the sum, the largest shape, and how many observations are over 0.7."""
    return each.groupBy(model).agg(F.sum("elpd").alias("elpd"), F.sqrt(F.count("*") * F.var_pop("elpd")).alias("se"), F.max("k").alias("worst_k"), F.count_if(F.col("k") > 0.7).alias("unsure"))
