import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from canvass.operators import bayes, clusters, famd, order
from canvass.operators import statistics as S


@pytest.mark.parametrize(
    ("rows", "value", "p"),
    [
        ([(86, 3826), (21, 942), (47, 2310)], 0.32208, 0.8513),
        ([(31, 904), (123, 6174)], 6.98987, 0.0082),
    ],
)
def test_chi_square_golden(rows, value, p):
    chi, _, got = S.chi_square([[a, n - a] for a, n in rows])
    assert chi == pytest.approx(value, abs=1e-4)
    assert got == pytest.approx(p, abs=5e-5)


def test_information_criteria_golden():
    b, a = S.bic(109902.3975, 2, 14, 7078)
    assert b == pytest.approx(-217686.12, abs=0.02)
    assert a == pytest.approx(-219326.80, abs=0.01)


def test_t_and_special_functions():
    t, p = S.t_test(5, 10.0, 4.0, 7, 8.0, 9.0)
    assert t == pytest.approx(2 / math.sqrt((4 * 4 + 6 * 9) / 10 * (1 / 5 + 1 / 7)))
    assert 0 < p < 1
    assert S.beta_i(0.5, 2, 2) == pytest.approx(0.5)
    assert S.log_gamma_q(1, 2.5) == pytest.approx(math.exp(-2.5))
    assert S.log_gamma_q(0.5, 0.3) == pytest.approx(math.erfc(math.sqrt(0.3)))


def test_shortest_interval_of_known_draws(spark):
    draws = spark.range(100).select(F.lit("a").alias("g"), F.when(F.col("id") < 95, F.col("id") / 128).otherwise(F.col("id") * 10.0).alias("v"))
    r = order.shortest_interval(draws, "v", ["g"], 0.9).first()
    assert (r["lo"], r["hi"]) == (0.0, 90 / 128)


def test_silhouette_in_blocks_equals_definition(spark):
    r = np.random.default_rng(1)
    x, label = r.standard_normal((60, 3)), r.integers(0, 3, 60)
    rows = spark.createDataFrame([(i, x[i].tolist(), int(label[i])) for i in range(60)], "id long, x array<double>, l long")
    got = {s["id"]: s["silhouette"] for s in clusters.silhouette(rows, "id", "x", "l", block=16).collect()}
    d = np.linalg.norm(x[:, None] - x, axis=2)
    for i in range(60):
        own = label == label[i]
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][label == k].mean() for k in set(label.tolist()) - {int(label[i])})
        assert got[i] == pytest.approx((b - a) / max(a, b))


def test_logistic_recovers_parameters(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal(4000)
    y = r.random(4000) < 1 / (1 + np.exp(-(-1 + 0.8 * x)))
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, x, strict=True)], "y double, x double")
    got = {m["param"]: m["mean"] for m in bayes.logistic_map(rows, "y", ["x"]).collect()}
    assert got["intercept"] == pytest.approx(-1, abs=0.15)
    assert got["x"] == pytest.approx(0.8, abs=0.15)


def test_chains_agree_with_each_other_and_the_truth(spark):
    rows = spark.createDataFrame([([1.0, -1.0], 500, 60), ([1.0, 1.0], 500, 220)], "x array<double>, n int, successes int")
    draws = bayes.sample_chains(rows, 2, [0.0, 0.0], [2.0, 1.0], draws=800).cache()
    r = {x["param"]: x for x in S.r_hat(draws, "value", "chain", ["param"]).collect()}
    assert all(v["r_hat"] < 1.05 and v["chains"] == 4 for v in r.values())
    means = {x["param"]: x["m"] for x in draws.groupBy("param").agg(F.avg("value").alias("m")).collect()}
    low, high = math.log(60 / 440), math.log(220 / 280)
    assert means[0] == pytest.approx((low + high) / 2, abs=0.1)
    assert means[1] == pytest.approx((high - low) / 2, abs=0.1)
    assert all(x["ess"] > 100 for x in bayes.effective_size(draws).collect())
    seg = spark.createDataFrame([("low", [1.0, -1.0]), ("high", [1.0, 1.0])], "segment string, x array<double>")
    rate = {x["segment"]: x["r"] for x in bayes.predict_segments(seg, draws).groupBy("segment").agg(F.avg("rate").alias("r")).collect()}
    assert rate["low"] == pytest.approx(0.12, abs=0.02)
    assert rate["high"] == pytest.approx(0.44, abs=0.03)


def test_kprototypes_covers_all_rows(spark):
    rows = spark.createDataFrame([(i, float(i % 2) * 10, "a" if i % 2 else "b") for i in range(40)], "id long, v double, c string")
    got = clusters.kprototypes(rows, "id", ["v"], ["c"], k=2)[0].collect()
    assert len(got) == 40
    assert len({r["cluster"] for r in got if r["id"] % 2}) == 1


def test_better_model_has_higher_elpd(spark):
    good = spark.range(200).select((F.col("id") % 10).alias("p"), (F.lit(-0.5) - F.col("id") % 3 / 10).alias("l"))
    bad = good.select("p", (F.col("l") - 1).alias("l"))
    assert bayes.waic(good, "p", "l").first()["elpd"] > bayes.waic(bad, "p", "l").first()["elpd"]


def test_order_without_a_task_for_a_group(spark):
    """A group over many partitions, ties, nulls, a null group, a single value."""
    r = np.random.default_rng(3)
    groups = {"hot": np.round(r.normal(0, 5, 3000)), "small": r.normal(0, 1, 7), "one": np.array([4.0]), None: np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("hot", None), ("none", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        x, begins = order._sorted(frame, ["g"], "v", [])
        assert begins.where("g = 'hot'").count() > 1
        ranked = order.ranks(frame, ["g"], "v").collect()
        q = {row.g: row.q for row in order.percentiles(frame, ["g"], "v", [0.03, 0.5, 0.97]).collect()}
        spans = {row.g: (row.lo, row.hi) for row in order.shortest_interval(frame, "v", ["g"], 0.9).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(q) == set(groups)
    for g, vs in groups.items():
        assert np.allclose(q[g], np.quantile(vs, [0.03, 0.5, 0.97]))
        mine = sorted((row["rank"], row.v) for row in ranked if row.g == g)
        assert [k for k, _ in mine] == list(range(1, len(vs) + 1)) and [v for _, v in mine] == sorted(vs) and {row.total for row in ranked if row.g == g} == {len(vs)}
    vs = np.sort(groups["hot"])
    w = int(len(vs) * 0.9)
    assert spans["hot"] == min(((lo, hi) for lo, hi in zip(vs, vs[w:], strict=False)), key=lambda p: (p[1] - p[0], p[0]))
    plan = order.percentiles(frame, ["g"], "v", [0.5])._jdf.queryExecution().toString()
    assert "Window" not in plan and "percentile" not in plan


def test_loo_on_a_conjugate_model(spark):
    """A normal mean with known spread: leaving one out is known exactly."""
    r = np.random.default_rng(5)
    y, sigma, prior = np.append(r.normal(1, 1, 40), 3.5), 1.0, 3.0
    weight = 1 / prior**2 + len(y) / sigma**2
    mu = r.normal(y.sum() / sigma**2 / weight, weight**-0.5, 4000)
    density = lambda v, m, s: -0.5 * ((v - m) / s) ** 2 - np.log(s) - 0.5 * np.log(2 * np.pi)
    rows = [("a", i, float(density(v, m, sigma))) for i, v in enumerate(y) for m in mu[:1500]] + [("a", 0, None), ("flat", 0, -1.0), ("few", 0, -1.0), ("few", 0, -2.0)]
    rows += [("flat", 0, -1.0)] * 99
    got = {(row.model, row.i): row for row in bayes.loo(spark.createDataFrame(rows, "model string, i int, l double"), ["model", "i"], "l").collect()}
    for i, v in enumerate(y):
        w = weight - 1 / sigma**2
        exact = density(v, (y.sum() - v) / sigma**2 / w, np.sqrt(1 / w + sigma**2))
        assert got["a", i].elpd == pytest.approx(exact, abs=0.02) and got["a", i].k < 0.7
    assert got["flat", 0].elpd == pytest.approx(-1.0)
    assert got["few", 0].k == math.inf
    raw, smooth = np.exp(3 * r.pareto(1.2, 2000).clip(0, 50) / 10), None
    smooth, k = bayes.smoothed_weights(-np.log(raw))
    assert np.exp(smooth).sum() == pytest.approx(1) and k > 0.7


def test_tail_shape_of_drawn_numbers():
    r = np.random.default_rng(1)
    for shape in (0.1, 0.5, 0.9):
        x = np.sort(2.0 * np.expm1(-shape * np.log(r.random(3000))) / shape)
        found, scale = bayes.tail_shape(x)
        assert found == pytest.approx(shape, abs=0.1) and scale == pytest.approx(2.0, rel=0.15)


def test_famd_against_the_dense_matrix(spark):
    r = np.random.default_rng(4)
    n = 300
    a, b = r.normal(3, 2, n), r.normal(0, 1, n)
    b = b + 0.5 * a
    g, h = r.choice(["x", "y", "", "zz"], n, p=[0.4, 0.3, 0.2, 0.1]).tolist(), r.choice(["u", "v"], n).tolist()
    g[5] = None
    rows = [(i, float(a[i]), None if i == 7 else float(b[i]), g[i], h[i]) for i in range(n)]
    frame = spark.createDataFrame(rows, "id int, a double, b double, g string, h string").repartition(3)
    found = famd.fit(frame, ["a", "b"], ["g", "h"], 4)
    known = np.delete(b, 7)
    z = np.column_stack([(a - a.mean()) / a.std(), np.where(np.arange(n) == 7, 0, (b - known.mean()) / known.std())])
    for values in (g, h):
        for level in sorted(set(values), key=lambda v: (v is not None, v or "")):
            own = np.array([v == level for v in values])
            z = np.column_stack([z, own / np.sqrt(own.mean()) - np.sqrt(own.mean())])
    values, axes = np.linalg.eigh(z.T @ z / n - np.outer(z.mean(0), z.mean(0)))
    values, axes = values[::-1], axes[:, ::-1]
    assert np.allclose(found.shares, values[:4] / values.sum())
    got = {row.id: [row.f0, row.f1, row.f2] for row in famd.coordinates(frame, "id", found).collect()}
    want = z @ axes[:, :3]
    want = want * np.sign((want * np.array([got[i] for i in range(n)])).sum(0))
    assert np.allclose([got[i] for i in range(n)], want, atol=1e-8)
    shares = famd.contributions(found)
    assert {c for c, _, _ in shares} == {"a", "b", "g", "h"} and sum(v for _, j, v in shares if j == 0) == pytest.approx(1)


def test_kprototypes_against_brute_starts(spark):
    """The cost isn't above the best of ten searches from rows drawn at random."""
    r = np.random.default_rng(7)
    n, k, gamma = 240, 3, 1.5
    label = r.integers(0, k, n)
    x = r.normal(0, 0.7, (n, 2)) + np.array([[0, 0], [2.5, 0], [0, 2.5]])[label]
    g = np.array(list("abc"))[np.where(r.random(n) < 0.8, label, r.integers(0, 3, n))]
    h = np.array(list("uv"))[np.where(r.random(n) < 0.7, label % 2, r.integers(0, 2, n))]

    def search(first):
        num, cat = x[first], [(g[i], h[i]) for i in first]
        before = np.inf
        while True:
            d = ((x[:, None] - num) ** 2).sum(2) + gamma * np.array([[(g[i] != a) + (h[i] != b) for a, b in cat] for i in range(n)])
            own, cost = d.argmin(1), d.min(1).sum()
            if cost >= before - 1e-9:
                return before
            before = cost
            mode = lambda v, m: min(set(v[m]), key=lambda t: (-(v[m] == t).sum(), t))
            num = np.array([x[own == c].mean(0) if (own == c).any() else num[c] for c in range(k)])
            cat = [(mode(g, own == c), mode(h, own == c)) if (own == c).any() else cat[c] for c in range(k)]

    brute = min(search(r.choice(n, k, replace=False)) for _ in range(10))
    frame = spark.createDataFrame([(i, float(a), float(b), str(s), str(t)) for i, ((a, b), s, t) in enumerate(zip(x, g, h, strict=True))], "id int, a double, b double, g string, h string")
    found, cost = clusters.kprototypes(frame, "id", ["a", "b"], ["g", "h"], k=k, starts=10)
    assert cost <= brute + 1e-6
    rows = found.collect()
    assert len(rows) == n and sum(row.distance for row in rows) == pytest.approx(cost, abs=1e-3)
    seeds = clusters._dense_seeds(frame, ["g", "h"], 3)
    freq = lambda v: (np.array([(g == v[0]).mean(), (h == v[1]).mean()])).mean()
    assert freq((seeds[0]["g"], seeds[0]["h"])) == pytest.approx(max(freq((a, b)) for a in "abc" for b in "uv"))
    nothing, _ = clusters.kprototypes(frame.where("false"), "id", ["a"], ["g"])
    assert nothing.collect() == []
