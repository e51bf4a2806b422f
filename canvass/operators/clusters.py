"""Clustering: sweeps over the number of clusters, K-prototypes, mixed-data
exact silhouettes."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass import storage
from canvass.operators.statistics import adjusted_rand, bic


def kmeans_sweep(rows: DataFrame, vector: str, ks, seed: int = 42) -> DataFrame:
    """k, cost (sum of squared distances) and silhouette (squared Euclidean, from
    cluster sums in one pass) for each k."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    x = rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))).select("features").cache()
    out = []
    for k in ks:
        model = KMeans(k=k, seed=seed, maxIter=30).fit(x)
        score = ClusteringEvaluator().evaluate(model.transform(x)) if k > 1 else 0.0
        out.append((k, round(model.summary.trainingCost, 4), round(score, 6)))
    x.unpersist()
    return rows.sparkSession.createDataFrame(out, "k int, cost double, silhouette double")


def gmm_sweep(rows: DataFrame, vector: str, ks, seed: int = 42) -> DataFrame:
    """k, log-likelihood, BIC and AIC of Gaussian mixtures."""
    x = rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))).select("features").cache()
    n, d = x.count(), len(x.first().features)
    out = []
    for k in ks:
        ll = GaussianMixture(k=k, seed=seed, maxIter=40).fit(x).summary.logLikelihood
        b, a = bic(ll, k, d, n)
        out.append((k, round(ll, 4), round(b, 4), round(a, 4)))
    x.unpersist()
    return rows.sparkSession.createDataFrame(out, "k int, log_likelihood double, bic double, aic double")


def _dense_seeds(base: DataFrame, categories: list[str], k: int) -> list[dict]:
    """Cao's seeds: the combination of categories whose levels are the most frequent,
    then again and again the one that is dense and far from those chosen.  Ties go to
    the first by name.  A seed at a time comes to the driver."""
    combos = base.groupBy(*categories).agg(F.count("*").alias("_n"))
    total = combos.agg(F.sum("_n").alias("_total"))
    for c in categories:
        combos = combos.join(combos.groupBy(c).agg(F.sum("_n").alias(f"_f_{c}")).withColumnRenamed(c, f"_k_{c}"), F.col(c).eqNullSafe(F.col(f"_k_{c}"))).drop(f"_k_{c}")
    density = sum((F.col(f"_f_{c}") for c in categories), F.lit(0)) / F.col("_total") / max(len(categories), 1)
    combos = storage.kept(combos.join(F.broadcast(total), F.lit(True)).select(*categories, density.alias("_density")), "seeds")
    seeds: list[dict] = []
    order = [F.col(c).asc_nulls_first() for c in categories]
    while len(seeds) < k:
        far = [F.col("_density") * sum(((~F.col(c).eqNullSafe(F.lit(s[c]))).cast("int") for c in categories), F.lit(0)) for s in seeds]
        score = F.col("_density") if not far else F.least(*far) if len(far) > 1 else far[0]
        first = combos.orderBy(score.desc(), *order).first()
        if first is None:
            break
        seeds.append({c: first[c] for c in categories})
    return seeds


_ASSIGNED = "start int, cluster int, variable int, level string, n long, value double"


def _assigned(falling: dict[int, list], numbers: list[str], categories: list[str], gamma: float):
    """Over a task's rows: for each start and cluster the number of rows with the sum
    of their distances (variable -1), of each number, and each level's rows (the
    variables by their places).  Ties go to the first cluster."""
    import pyarrow as pa

    k, p = len(next(iter(falling.values()))), len(numbers)
    cells = [(s, i) for s in falling for i in range(k)]

    def run(batches):
        sums, levels = np.zeros((len(cells), 2 + p)), [{} for _ in categories]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = [np.asarray(batch.column(f"n{j}")) for j in range(p)]
            coded = [batch.column(f"c{j}").dictionary_encode() for j in range(len(categories))]
            names = [[*c.dictionary.to_pylist(), None] for c in coded]
            codes = [np.where(np.asarray(c.indices.is_null()), len(n) - 1, np.asarray(c.indices.fill_null(0))) for c, n in zip(coded, names, strict=True)]
            for at, (_, prototypes) in enumerate(falling.items()):
                d = np.zeros((batch.num_rows, k))
                for i, (num, cat) in enumerate(prototypes):
                    for c, v in zip(numbers, x, strict=True):
                        d[:, i] += (v - num[c]) ** 2
                    for c, v, n in zip(categories, codes, names, strict=True):
                        d[:, i] += gamma * (v != (n.index(cat[c]) if cat[c] in n else -1))
                cluster = d.argmin(1)
                here = slice(at * k, at * k + k)
                for j, v in enumerate([np.ones(len(d)), d[np.arange(len(d)), cluster], *x]):
                    sums[here, j] += np.bincount(cluster, v, k)
                for v, n, seen in zip(codes, names, levels, strict=True):
                    counts = np.bincount(cluster * len(n) + v, minlength=k * len(n)).reshape(k, -1)
                    for j, level in enumerate(n):
                        if counts[:, j].any():
                            seen.setdefault(level, np.zeros(len(cells), np.int64))[here] += counts[:, j]
        out = [(s, i, j - 1, None, int(r[0]), float(r[1 + j])) for (s, i), r in zip(cells, sums, strict=True) if r[0] for j in range(1 + p)]
        out += [(s, i, p + j, level, int(n), 0.0) for j, seen in enumerate(levels) for level, counts in seen.items() for (s, i), n in zip(cells, counts, strict=True) if n]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.float64()]
        columns = list(zip(*out, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["start", "cluster", "variable", "level", "n", "value"])

    return run


def kprototypes(rows: DataFrame, key: str, numbers: list[str], categories: list[str], k: int = 3, gamma: float = 1.5, starts: int = 10, rounds: int = 30, seed: int = 42) -> tuple[DataFrame, float]:
    """Clusters of mixed rows: squared distance of numbers plus gamma for each
    category that differs.  Returns ``key, cluster, distance`` of the cheapest of
    some starts, and its cost.

    All starts have Cao's seeds for their categories and numbers drawn around the
    columns' means.  A round is one pass: each task assigns its rows for all starts
    that still fall and returns sums of numbers and counts of levels by start and
    cluster.  Missing numbers count as 0, a missing category is a level."""
    base = storage.kept(rows.select(key, *numbers, *(F.col(c).cast("string").alias(c) for c in categories)), "prototypes")
    plain = base.select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"n{j}") for j, c in enumerate(numbers)), *(F.col(c).alias(f"c{j}") for j, c in enumerate(categories)), F.lit(1).alias("one"))
    stats = base.agg(F.count("*").alias("n"), *(f(c).alias(f"{m}_{c}") for c in numbers for m, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not stats.n:
        return base.select(key, F.lit(0).alias("cluster"), F.lit(0.0).alias("distance")), 0.0
    draw = np.random.default_rng(seed)
    seeds = _dense_seeds(base, categories, k) if categories else [{}] * k
    drawn = {s: [({c: float((stats[f"m_{c}"] or 0) + (stats[f"s_{c}"] or 0) * draw.standard_normal()) for c in numbers}, dict(seeds[i])) for i in range(k)] for s in range(starts)}

    def nearest(prototypes: list) -> F.Column:
        parts = []
        for i, (num, cat) in enumerate(prototypes):
            d = sum((F.pow(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - num[c], 2) for c in numbers), F.lit(0.0))
            d = d + gamma * sum(((~F.col(c).eqNullSafe(F.lit(cat[c]))).cast("int") for c in categories), F.lit(0))
            parts.append(F.struct(d.alias("distance"), F.lit(i).alias("cluster")))
        return F.array_min(F.array(*parts))

    best: dict[int, tuple[float, list]] = {}
    falling = dict(drawn)
    for _ in range(rounds):
        found = plain.mapInArrow(_assigned(falling, numbers, categories, gamma), _ASSIGNED).groupBy("start", "cluster", "variable", "level").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
        # The commonest level of each variable is found before anything comes to the driver.
        found = found.groupBy("start", "cluster", "variable").agg(F.min_by(F.struct("level", "n", "value"), F.struct((-F.col("n")).alias("n"), "level")).alias("r")).select("start", "cluster", "variable", "r.*").collect()
        costs: dict[int, float] = {}
        for r in found:
            if r.variable == -1:
                costs[r.start] = costs.get(r.start, 0.0) + r.value
        still = {s for s, c in costs.items() if s not in best or c < best[s][0] - 1e-9 * max(1.0, abs(best[s][0]))}
        best |= {s: (costs[s], falling[s]) for s in still}
        if not still:
            break
        modes = {(r.start, r.cluster, categories[r.variable - len(numbers)]): r.level for r in found if r.variable >= len(numbers)}
        means = {(r.start, r.cluster): {} for r in found if r.variable == -1}
        for r in found:
            if 0 <= r.variable < len(numbers):
                means[r.start, r.cluster][numbers[r.variable]] = r.value / r.n
        falling = {s: [(means.get((s, i), num), {c: modes.get((s, i, c), cat[c]) for c in categories}) if (s, i) in means else (num, cat) for i, (num, cat) in enumerate(falling[s])] for s in still}
    cost, prototypes = min(best.values(), key=lambda b: b[0])
    return base.select(key, nearest(prototypes).alias("m")).select(key, "m.cluster", F.round("m.distance", 6).alias("distance")), cost


def kprototypes_sweep(rows: DataFrame, key: str, numbers: list[str], categories: list[str], ks, **settings) -> DataFrame:
    """``k, cost``: the cheapest start's cost for each number of clusters."""
    out = [(k, round(kprototypes(rows, key, numbers, categories, k=k, **settings)[1], 4)) for k in ks]
    return rows.sparkSession.createDataFrame(out, "k int, cost double")


def _blocks(n: int, block: int | None) -> int:
    """Blocks of n points: every point is sent to each of them twice, so they are
    as large as a task can hold, but eight at least that tasks have work."""
    return max(1, -(-n // block) if block else min(-(-n // 2000), max(8, -(-n // 16_000))))


def silhouette(points: DataFrame, key: str, vector: str, label: str, block: int | None = None) -> DataFrame:
    """key, label, silhouette of each point by Euclidean distance, as defined:
    all points against all points, block against block, in numpy inside the
    tasks.  What a pair of blocks gives is a sum per point and label."""
    n = _blocks(points.count(), block)
    rows = points.select(F.col(key).alias("k"), F.col(vector).alias("x"), F.col(label).alias("l"), F.pmod(F.xxhash64(key), F.lit(n)).alias("block"))
    spine = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    left = rows.withColumn("other", F.explode(spine))
    right = rows.select("k", "x", "l", F.col("block").alias("other"), F.explode(spine).alias("block"))

    def sums(a, b):
        import pandas as pd

        if not len(a) or not len(b):
            return pd.DataFrame({"k": [], "own": [], "l": [], "s": [], "n": []})
        x, y = np.stack(a["x"].to_numpy()), np.stack(b["x"].to_numpy())
        kinds, at = np.unique(b["l"].to_numpy(), return_inverse=True)
        member = (at[:, None] == np.arange(len(kinds))).astype(float)
        total, y2 = np.zeros((len(a), len(kinds))), (y**2).sum(1)
        for low in range(0, len(a), 256):
            some = slice(low, low + 256)
            d = np.sqrt(np.maximum((x[some] ** 2).sum(1)[:, None] + y2 - 2 * x[some] @ y.T, 0))
            d[a["k"].to_numpy()[some, None] == b["k"].to_numpy()] = 0
            total[some] = d @ member
        return pd.DataFrame({"k": np.repeat(a["k"].to_numpy(), len(kinds)), "own": np.repeat(a["l"].to_numpy(), len(kinds)), "l": np.tile(kinds, len(a)), "s": total.ravel(), "n": np.tile(np.bincount(at), len(a))})

    part = left.groupBy("block", "other").cogroup(right.groupBy("block", "other")).applyInPandas(sums, "k long, own long, l long, s double, n long")
    per = part.groupBy("k", "own", "l").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    mean = F.when(F.col("own") == F.col("l"), F.col("s") / F.nullif(F.col("n") - 1, F.lit(0))).otherwise(F.col("s") / F.col("n"))
    ab = per.groupBy("k", "own").agg(F.max(F.when(F.col("own") == F.col("l"), mean)).alias("a"), F.min(F.when(F.col("own") != F.col("l"), mean)).alias("b"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return ab.select(F.col("k").alias(key), F.col("own").alias(label), value.alias("silhouette"))


def bootstrap_stability(rows: DataFrame, key: str, vector: str, k: int, times: int = 30, seed: int = 42) -> DataFrame:
    """The adjusted Rand index of k-means on each of some resamples (with
    replacement, as large as the rows) against k-means on all: resample, ari."""
    x = rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))).select(key, "features").cache()
    label = lambda model, name: model.transform(x if name == "reference" else drawn).select(key, F.col("prediction").alias(name))
    reference = label(KMeans(k=k, seed=seed, maxIter=30).fit(x), "reference").cache()
    out = []
    for i in range(times):
        drawn = x.sample(withReplacement=True, fraction=1.0, seed=i).cache()
        again = label(KMeans(k=k, seed=i, maxIter=30).fit(drawn), "again")
        out.append((i, float(adjusted_rand(reference.join(again, key), "reference", "again").first().ari)))
        drawn.unpersist()
    reference.unpersist()
    x.unpersist()
    return rows.sparkSession.createDataFrame(out, "resample int, ari double")


def principal_axes(rows: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """Coordinates of each row on the first k principal axes, c0, c1 and so on;
    an axis points the way that makes its largest loading positive."""
    x = rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))).select(key, vector, "features")
    axes = PCA(k=k, inputCol="features", outputCol="o").fit(x).pc.toArray()
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    dot = lambda a: F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), F.array(*map(F.lit, a)), lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    return x.select(key, *(dot(axes[:, i].tolist()).alias(f"c{i}") for i in range(k)))


def memberships(rows: DataFrame, key: str, vector: str, k: int, seed: int = 42) -> DataFrame:
    """The set that goes into a model beside clusters: the likeliest component of
    a Gaussian mixture, and all but the last of its k probabilities."""
    x = rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))).select(key, "features")
    scored = GaussianMixture(k=k, seed=seed, maxIter=100, tol=1e-6).fit(x).transform(x).withColumn("p", vector_to_array("probability"))
    return scored.select(key, F.col("prediction").alias("cluster_hard"), *(F.col("p")[i].alias(f"cluster_prob_{i}") for i in range(k - 1)))


def gower(points: DataFrame, key: str, numbers: list[str], categories: list[str], others: DataFrame | None = None) -> DataFrame:
    """Gower distance of every point to each of ``others``, a small stated set of
    rows (medoids, say; the points' own if none are given, then all pairs: for a
    bounded table only).  a, b, distance; a missing value leaves its column out."""
    others = points if others is None else others
    span = points.agg(*(F.nullif(F.max(c) - F.min(c), F.lit(0)).alias(f"s_{c}") for c in numbers))
    cols = [*numbers, *categories]
    left = points.select(F.col(key).alias("a"), F.struct(*cols).alias("x")).join(F.broadcast(span), F.lit(True)) if numbers else points.select(F.col(key).alias("a"), F.struct(*cols).alias("x"))
    both = left.join(others.select(F.col(key).alias("b"), F.struct(*cols).alias("y")), F.lit(True))
    gaps = [F.when(F.col(f"x.{c}").isNotNull() & F.col(f"y.{c}").isNotNull(), F.coalesce(F.abs(F.col(f"x.{c}") - F.col(f"y.{c}")) / F.col(f"s_{c}"), F.lit(0.0))) for c in numbers]
    gaps += [F.when(F.col(f"x.{c}").isNotNull() & F.col(f"y.{c}").isNotNull(), (F.col(f"x.{c}") != F.col(f"y.{c}")).cast("double")) for c in categories]
    total = sum((F.coalesce(g, F.lit(0.0)) for g in gaps), F.lit(0.0))
    known = sum((g.isNotNull().cast("int") for g in gaps), F.lit(0))
    return both.select("a", "b", (total / F.nullif(known, F.lit(0))).alias("distance"))
