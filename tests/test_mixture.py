"""The Dirichlet-process mixture on planted clusters."""

import math

import numpy as np

from canvass.operators import mixture


def test_digamma():
    x = np.array([0.1, 0.5, 1.0, 3.7, 50.0])
    step = 1e-5
    assert np.allclose(mixture.digamma(x), [(math.lgamma(v + step) - math.lgamma(v - step)) / (2 * step) for v in x], atol=1e-5)


def test_planted_components(spark):
    r = np.random.default_rng(2)
    centres = np.array([[0.0, 0.0], [6.0, 0.0], [0.0, 7.0]])
    label = r.integers(0, 3, 900)
    points = centres[label] + r.normal(0, 1, (900, 2)) @ np.array([[1.0, 0.4], [0.0, 0.6]])
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    frame = spark.createDataFrame([*rows, (900, None), (901, [1.0, None]), (902, [float("nan"), 1.0])], "id int, x array<double>").repartition(3)
    model, bounds = mixture.fit(frame, "x", components=8, rounds=60)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(bounds, bounds[1:], strict=False)) and bounds[-1] > bounds[0]
    weights = model.weights()
    used = np.flatnonzero(weights > 0.05)
    assert len(used) == 3 and weights[used].sum() > 0.97  # the other five are empty
    for c in centres:
        assert np.abs(model.mean[used] - c).max(1).min() < 0.25
    assert np.allclose(np.sort(weights[used]), np.sort(np.bincount(label) / 900), atol=0.03)
    found = {row.id: row for row in mixture.predict(frame, "id", "x", model).collect()}
    assert len(found) == 903 and all(found[i].component is None for i in (900, 901, 902))
    for k in range(3):
        mine = [found[i].component for i in range(900) if label[i] == k]
        assert max(mine.count(c) for c in used) > 0.97 * len(mine)
    assert all(0 <= found[i].entropy <= math.log(8) for i in range(900))
