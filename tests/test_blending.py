"""Blends against loops over folds in NumPy."""

from itertools import combinations

import numpy as np
import pytest

from strataflow.operators import blending as B


@pytest.fixture(scope="module")
def arms():
    rng = np.random.default_rng(9)
    n = 400
    group = rng.integers(0, 20, n)
    truth = rng.normal(size=n) * 10
    near = truth + rng.normal(size=n) * 3
    far = truth * 0.6 + rng.normal(size=n) * 2
    odd = rng.normal(size=n) * 20
    return group, group % 4, truth, np.stack([near, far, odd], axis=1)


def test_simplex_weights_match_a_fine_grid():
    rng = np.random.default_rng(1)
    steps = [(a / 40, b / 40, 1 - a / 40 - b / 40) for a in range(41) for b in range(41 - a)]
    for _ in range(20):
        x = rng.normal(size=(50, 3)) * rng.uniform(0.2, 3, 3)
        g = x.T @ x / 50
        w = B.simplex_weights(g)
        assert abs(w.sum() - 1) < 1e-12 and (w >= 0).all()
        assert w @ g @ w <= min(np.array(s) @ g @ np.array(s) for s in steps) + 1e-9


def test_gated_blend_matches_plain_loops(spark, arms):
    group, fold, y, x = arms
    rows = [(int(i), int(g), int(f), float(t), *map(float, v)) for i, (g, f, t, v) in enumerate(zip(group, fold, y, x, strict=True))]
    df = spark.createDataFrame(rows, "i long, g long, fold int, y double, a double, b double, c double").repartition(5)
    out, fits = B.gated_blend(df, ["a", "b", "c"], "y", "g", "fold", 4, 6.0, [0.0, 2.0, 4.0, 8.0])
    got = {r.i: r for r in out.collect()}
    mid = np.median(x, axis=1, keepdims=True)
    w = np.clip(x, mid - 6, mid + 6)
    e = w - y[:, None]
    for f in range(4):
        out_, in_ = fold != f, fold == f
        weights = B.simplex_weights(e[out_].T @ e[out_] / out_.sum())
        assert np.allclose(fits["weights"][f], weights)
        blend = w @ weights
        d, t = blend - w[:, 0], y - w[:, 0]
        a, b = np.linalg.lstsq(np.stack([d[out_], d[out_] ** 3], axis=1), t[out_], rcond=None)[0]
        assert np.allclose(fits["cubics"][f], (a, b))
        new = w[:, 0] + a * d + b * d**3
        gain = (w[:, 0] - y) ** 2 - (new - y) ** 2
        best = None
        for p, (i, j) in enumerate(combinations(range(3), 2)):
            apart = np.array([np.abs(w[group == g, i] - w[group == g, j]).mean() for g in range(20)])
            for v in (0.0, 2.0, 4.0, 8.0):
                found = gain[out_ & (apart[group] >= v)].sum(), -p, v
                if best is None or found > best[0]:
                    best = found, (i, j), v, apart
        (value, _, _), (i, j), v, apart = best
        assert fits["gates"][f] == ("abc"[i], "abc"[j], v if value > 0 else float("inf"))
        want = np.where(apart[group] >= fits["gates"][f][2], new, w[:, 0])
        assert all(abs(got[k].prediction - want[k]) < 1e-9 and abs(got[k].blend - blend[k]) < 1e-9 for k in np.flatnonzero(in_).tolist())


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, 0, 1.0, None, 2.0), (2, 0, None, 1.0, 2.0), (3, 1, 4.0, 3.0, 5.0)], "g long, fold int, y double, a double, b double")
    out, fits = B.gated_blend(df, ["a", "b"], "y", "g", "fold", 2, 1.0, [0.0])
    got = {r.g: r for r in out.collect()}
    assert got[1].blend is None and got[2].blend is not None and got[3].blend is not None
    assert fits["weights"][1].tolist() == [0.5, 0.5]
    assert B.gated_blend(df.limit(0), ["a", "b"], "y", "g", "fold", 2, 1.0, [0.0])[0].count() == 0
