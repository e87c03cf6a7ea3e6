"""Queries do the whole job: no rows are left out and none are mixed up."""

import math

import numpy as np

from strataflow.plans import learning, lookups, registry
from strataflow.tables import table

SF = "/root/testdata/sf0.001"


def test_learners_predict_every_line(spark):
    want = table(spark, SF, "lineitem").count()
    assert learning.lines(spark, SF).count() == want
    assert registry.queries()["x9_ridge_out_of_fold"](spark, SF).count() == want


def test_rows_of_long_wells_keep_their_own_neighbours(spark, monkeypatch):
    queries = {(1, 2003): (0.0, 0.0), (3, 3): (100.0, 100.0)}  # both are 3003 in the SQL
    near = {(2, i): (float(i % 6), float(i)) for i in range(20)} | {(2, 20 + i): (100.0 + i % 6, 100.0 + i) for i in range(20)}
    w = spark.createDataFrame([(*k, *v) for k, v in queries.items()], "well_id long, row_idx long, x double, y double")
    p = spark.createDataFrame([(a, a * 100000 + b, *v, float(b)) for (a, b), v in near.items()], "well_id long, point_id long, x double, y double, value double")
    monkeypatch.setattr(lookups, "wells", lambda *_: w)
    monkeypatch.setattr(lookups, "points", lambda *_: p)
    sx, sy = np.std([v[0] for v in near.values()]), np.std([v[1] for v in near.values()])
    want = []
    for x, y in queries.values():
        d = sorted((round(math.hypot((a - x) / sx, (b - y) / sy), 9), k[0] * 100000 + k[1]) for k, (a, b) in near.items())[:10]
        want += [(n + 1, i) for n, (_, i) in enumerate(d)]
    got = registry.queries()["j4_knn_other_wells"](spark, SF).collect()
    assert sorted((r["rank"], r.point_id) for r in got) == sorted(want) and {r.query_id for r in got} == {3003}
    for name in ("j4_idw", "j6_idw_power_two", "j5_local_plane"):
        assert len(registry.queries()[name](spark, SF).collect()) == 2
