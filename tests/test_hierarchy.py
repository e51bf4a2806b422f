"""The hierarchical model against a dense Newton search, and on planted effects."""

import numpy as np
import pytest

from canvass.operators import hierarchy

GROUPS, EACH = 25, 120


@pytest.fixture(scope="module")
def planted():
    r = np.random.default_rng(8)
    n = GROUPS * EACH
    group, kind, slope = np.repeat(np.arange(GROUPS), EACH), r.integers(0, 3, n), r.normal(0, 1, n)
    effect, levels = r.normal(0, 0.6, GROUPS), np.array([-0.4, 0.0, 0.5])
    opened = r.random(n) < 1 / (1 + np.exp(-(-1.0 + effect[group] + levels[kind] + 0.5 * slope)))
    clicked = opened & (r.random(n) < 1 / (1 + np.exp(-(-0.5 + 0.4 * slope))))
    return group, kind, slope, opened, clicked, effect


def test_effects_and_slopes_are_found(spark, planted):
    group, kind, slope, opened, clicked, effect = planted
    rows = [(int(g), "abc"[k], float(s), bool(o), bool(c)) for g, k, s, o, c in zip(group, kind, slope, opened, clicked, strict=True)]
    rows += [(0, None, None, True, None), (None, "a", 1.0, True, True), (1, "a", 0.0, None, None)]
    frame = spark.createDataFrame(rows, "g int, kind string, slope double, opened boolean, clicked boolean")
    found = hierarchy.two_stages(frame, "opened", "clicked", "g", {"kind": 0.5}, {"slope": 0.3}, close=1e-4).collect()
    stage = {s: {(r.kind, r.name): (r.mean, r.sd) for r in found if r.stage == s} for s in ("open", "click")}
    first = stage["open"]
    mine = np.array([first["group", str(g)][0] for g in range(GROUPS)])
    assert np.corrcoef(mine, effect)[0, 1] > 0.9
    gap = (mine - mine.mean()) - (effect - effect.mean())  # the mean is shared with the levels
    assert np.mean(np.abs(gap) < 3 * np.array([first["group", str(g)][1] for g in range(GROUPS)])) > 0.9
    assert abs(first["shared", "slope"][0] - 0.5) < 3 * first["shared", "slope"][1] + 0.05
    assert first["shared", "kind[a]"][0] < first["shared", "kind[b]"][0] < first["shared", "kind[c]"][0]
    assert 0.4 < first["spread", "g"][0] < 0.8
    assert abs(stage["click"]["shared", "slope"][0] - 0.4) < 0.2
    assert stage["click"]["spread", "g"][0] < first["spread", "g"][0]

    # The mode, given the spread that was found, by Newton steps on the whole Hessian.
    y = np.append(opened, True).astype(float)
    s = np.append(slope, np.nan)
    s = np.nan_to_num((s - np.nanmean(np.append(slope, [np.nan, 0.0]))) / np.nanstd(np.append(slope, [np.nan, 0.0])))
    x = np.column_stack([np.ones(len(y)), np.append(kind, -1)[:, None] == np.arange(3), s, np.append(group, 0)[:, None] == np.arange(GROUPS)]).astype(float)
    y, x = np.append(y, []), x
    sd = np.array([1.0, 0.5, 0.5, 0.5, 0.3] + [first["spread", "g"][0]] * GROUPS)
    prior = np.zeros(len(sd))
    prior[0] = -3.0
    b = prior.copy()
    b[0] = -1.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(1 / sd**2)
        b = b + np.linalg.solve(h, x.T @ (y - p) - (b - prior) / sd**2)
    cov = np.linalg.inv(h)
    names = ["intercept", "kind[a]", "kind[b]", "kind[c]", "slope"]
    assert np.allclose([first["shared", n][0] for n in names], b[:5], atol=1e-3)
    assert np.allclose([first["shared", n][1] for n in names], np.sqrt(np.diag(cov))[:5], atol=1e-3)
    assert np.allclose(mine, b[0] + b[5:], atol=1e-3)
    own = [cov[0, 0] + cov[5 + g, 5 + g] + 2 * cov[0, 5 + g] for g in range(GROUPS)]
    assert np.allclose([first["group", str(g)][1] for g in range(GROUPS)], np.sqrt(own), atol=1e-3)


def test_too_many_levels(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "MOST_SHARED", 3)
    frame = spark.createDataFrame([(1, str(k), True) for k in range(9)], "g int, kind string, y boolean")
    with pytest.raises(ValueError, match="shared"):
        hierarchy.fit(frame, "y", "g", {"kind": 0.5}, {})
