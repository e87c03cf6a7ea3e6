"""Centroid clustering against a plain loop, with screening that prunes and screening that can't."""

import hashlib
import math

import numpy as np
import pytest

from strataflow.llm import clustering as C

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, k=16, rounds=3):
    """(vec_id, cluster, distance) by the task's words, with Python's integers."""
    kept = [(i, [math.floor(64 * float(v)) for v in x]) for i, x in rows if x and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x)]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())
    c = [x for _, x in first[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        at = [near(x)[1] for _, x in kept]
        c = [[sum(v) // len(v) for v in zip(*[x for (_, x), a in zip(kept, at, strict=True) if a == j], strict=True)] or m for j, m in enumerate(c)]
    return order((i, near(x)[1], min(near(x)[0], C.LONGEST)) for i, x in kept), c


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def got(spark, rows):
    d = spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA)
    out = C.cluster(d).collect()
    return out, order((r.vec_id, r.cluster, r.distance) for r in out)


def vectors(seed, n, spread=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, 64)) * rng.uniform(0, 4, size=(6, 64)) ** 2
    return [(i, [float(v) for v in middle[i % 6] + rng.normal(size=64) * spread]) for i in range(n)]


def test_matches_a_plain_loop(spark):
    rows = vectors(1, 150)
    out, mine = got(spark, rows)
    want, centroids = plain(rows)
    assert mine == want
    inertia = {}
    for _, c, d in want:
        inertia[c] = inertia.get(c, 0) + d
    for r in out:
        assert (r.cluster_inertia, r.inertia) == (inertia[r.cluster], sum(inertia.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_odd_rows(spark):
    rows = vectors(2, 40)
    rows += [(None, rows[0][1]), (100, None), (101, []), (102, rows[1][1][:63]), (103, [float("nan"), *rows[1][1][1:]]), (104, [None, *rows[1][1][1:]])]
    rows += [(105, [float("inf"), *rows[1][1][1:]]), rows[7], rows[7], (106, [1e12, *rows[1][1][1:]]), (107, [-600.0, *rows[1][1][1:]])]
    d = spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA).selectExpr("*", "1 AS cluster", "'a' AS norms", "2 AS x")
    assert order((r.vec_id, r.cluster, r.distance) for r in C.cluster(d).collect()) == plain(rows)[0]


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    rows = vectors(3, 6)[:n]
    _, mine = got(spark, rows)
    assert mine == (plain(rows)[0] if rows else [])


def test_wide_integers_and_saturation(spark):
    rows = [(i, [float(2 ** (20 + i)) * (1 if j % 2 else -1) for j in range(64)]) for i in range(20)]
    _, mine = got(spark, rows)
    assert mine == plain(rows)[0] and any(r[2] == C.LONGEST for r in mine)


def test_screening_leaves_few_exact_distances_where_lengths_differ():
    """Exact distances with clusters that differ in where their length lies, and on unit vectors of random direction."""
    rng = np.random.default_rng(4)
    place = np.repeat(np.eye(8), 8, axis=1)
    x = (place[rng.integers(0, 8, 4000)] * 40 + rng.normal(size=(4000, 64)) * 3).astype(np.int64)
    c = (np.concatenate([place, place * 0.5]) * 40).astype(np.int64)
    at, d, exact = C.screen(x, C.segment_norms(x, 8), c, C.segment_norms(c, 8))
    every = ((x[:, None].astype(float) - c[None]) ** 2).sum(axis=2)
    assert (at == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
    assert exact < 1.2 * len(x)
    x = rng.normal(size=(2000, 64))
    x = np.floor(64 * x / np.sqrt((x**2).sum(axis=1))[:, None]).astype(np.int64)
    at, d, exact = C.screen(x, C.segment_norms(x, 8), x[:16], C.segment_norms(x[:16], 8))
    every = ((x[:, None].astype(float) - x[None, :16]) ** 2).sum(axis=2)
    assert (at == every.argmin(axis=1)).all() and exact <= 16 * len(x)


def test_bound_is_never_more_than_the_distance():
    rng = np.random.default_rng(5)
    for scale in (1, 100, 10**6):
        x, c = (rng.integers(-scale, scale + 1, size=(300, 64)) for _ in range(2))
        bound = ((C.segment_norms(x, 8) - C.segment_norms(c, 8)) ** 2).sum(axis=1)
        assert (bound <= ((x - c) ** 2).sum(axis=1) * (1 + 1e-12)).all()
