"""Operators on small hand tables, contracts, order of rows, sources and streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.operators import aggregates as A
from strataflow.operators import contracts, crossfit, lookup, ranking, spatial
from strataflow.operators import sequence as S
from strataflow.sources import wells as io


def wells(spark, rows, cols="well_id long, row_idx long, md double, x double, y double, z double, gr double, tvt_input double"):
    return spark.createDataFrame(rows, cols)


def one(spark, gr, known=None):
    known = len(gr) if known is None else known
    return wells(spark, [(1, i, float(i), float(i), 0.0, 0.0, g, 5.0 + i if i < known else None) for i, g in enumerate(gr)])


def col(df, name):
    return [r[name] for r in df.orderBy("row_idx").collect()]


def test_fill_linear_at_gaps_and_ends(spark):
    got = one(spark, [None, 1.0, None, None, 4.0, None]).withColumn("f", S.fill_linear("gr"))
    assert col(got, "f") == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]
    empty = one(spark, [None, None]).withColumn("f", S.fill_linear("gr", fallback=F.lit(85.0)))
    assert col(empty, "f") == [85.0, 85.0]


def test_gradient_and_runs(spark):
    got = S.gradient_in_runs(one(spark, [1.0, 3.0, None, 7.0, None, 1.0, 2.0, 4.0]), "gr")
    assert col(got, "gradient_gr") == [2.0, 2.0, None, None, None, 1.0, 1.5, 2.0]


def test_unwrap(spark):
    a = np.linspace(0, 9, 12)
    d = one(spark, [float((v + math.pi) % (2 * math.pi) - math.pi) for v in a])
    assert np.allclose(col(S.unwrap(d, "gr"), "unwrapped_gr"), a)


def test_half_turns_fall_as_in_the_c_library(spark):
    """A move and its opposite: whether they are a jump is in the last bit of the angles (w8 on 60 x sf0.1, well 13023)."""
    tenths = [(-49, 66), (3, 83), (-50, 149), (-139, 177), (-125, 207), (-201, 173), (-111, 150), (-157, 131), (-172, 127), (-169, 100), (-110, 92), (-22, 76)]
    tenths += [(42, 109), (-46, 48), (-33, 45), (29, 34), (36, 85), (-2, 111), (90, 108), (190, 111), (112, 188), (69, 140), (-11, 96), (66, 64), (173, 133)]
    xy = [(x / 10.0, y / 10.0) for x, y in tenths]
    back = [xy[max(i - 5, 0)] for i in range(len(xy))]
    a = [math.atan2(y - v, x - u) for (x, y), (u, v) in zip(xy, back, strict=True)]
    turns = np.cumsum([0] + [-1 if q - p > math.pi else 1 if q - p < -math.pi else 0 for p, q in zip(a, a[1:], strict=False)])
    d = wells(spark, [(1, i, 0.0, x, y, 0.0, None, None) for i, (x, y) in enumerate(xy)])
    got = col(S.unwrap(d.withColumn("a", S.azimuth(5, S.c_atan2)), "a"), "unwrapped_a")
    assert np.allclose(got, a + turns * 2 * math.pi, atol=1e-9)
    wrong = col(S.unwrap(d.withColumn("a", S.azimuth(5)), "a"), "unwrapped_a")
    assert not np.allclose(wrong, got, atol=1e-9)
    gap = wells(spark, [(1, 0, 0.0, 1.0, None, 0.0, None, None)])
    assert col(gap.withColumn("a", S.azimuth(5, S.c_atan2)), "a") == [None]


def test_gradients_in_blocks_are_those_of_all_pairs(spark):
    """Blocks of a few queries, and points in several parts, give what each query and all its support wells' steps give; pairs never are rows."""
    rng = np.random.default_rng(5)
    rows, steps = [], {}
    for w in range(9):
        xy = rng.integers(0, 40, 2) * 3 + np.cumsum(rng.integers(-3, 4, (14, 2)), axis=0) / 1.0
        rows += [(w, i, float(x), float(y)) for i, (x, y) in enumerate(xy)]
        for i in range(1, 14):
            dx, dy = xy[i] - xy[i - 1]
            steps[w, i] = (float(xy[i][0]), float(xy[i][1]), float(dx), float(dy), float(0.5 * dx - 0.25 * dy + (4.0 if i == 5 else 0.1 * (i % 3))))
    q = spark.createDataFrame(rows, "well_id long, row_idx long, x double, y double").where("row_idx > 8 and well_id > 0")
    p = spark.createDataFrame([(*k, *v) for k, v in steps.items()], "well_id long, row_idx long, x double, y double, dx double, dy double, ds double")
    near = {w: [(w + j) % 9 for j in (1, 2, 4)] for w in range(1, 8)}
    support = spark.createDataFrame([(w, o) for w, os in near.items() for o in os], "well_id long, other long")

    def fit(w, dx, dy, ds):
        xx, xy, yy, xs, ys = (float((w * v).sum()) for v in (dx * dx, dx * dy, dy * dy, dx * ds, dy * ds))
        det = xx * yy - xy * xy
        return ((xs * yy - ys * xy) / det, (ys * xx - xs * xy) / det) if det > 1e-6 * xx * yy else None

    want = {}
    for w, i, x, y in rows:
        if i <= 8 or w not in near:
            continue
        some = sorted((round(math.hypot(x - v[0], y - v[1]), 9), o, r) for (o, r), v in steps.items() if o in near[w])[:10]
        dx, dy, ds = np.array([steps[o, r][2:] for _, o, r in some]).T
        weight = 1 / np.maximum([d for d, _, _ in some], 1e-6) ** 2
        found = fit(weight, dx, dy, ds)
        if found:
            u = (ds - found[0] * dx - found[1] * dy) / 3.0
            found = fit(np.where(abs(u) < 1, weight * (1 - u * u) ** 2, 0), dx, dy, ds) or found
        want[w, i] = found
    for block_rows, block_points in ((4096, 262_144), (7, 262_144), (7, 20), (1, 5)):
        got = spatial.local_gradient(q, support, p, 10, block_rows=block_rows, block_points=block_points)
        found = {(r.well_id, r.row_idx): None if r.gx is None else (r.gx, r.gy) for r in got.collect()}
        assert found.keys() == want.keys()
        assert all((found[k] is None) == (v is None) and (v is None or np.allclose(found[k], v, atol=1e-6)) for k, v in want.items())
    whole = spatial.local_gradient(q, support, p, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in whole and "Window" not in whole


def test_known_split_drops_short_wells(spark):
    assert S.known_counts(one(spark, [0.0] * 12, 9)).count() == 0
    assert S.known_counts(one(spark, [0.0] * 12, 12)).count() == 0
    assert S.known_counts(one(spark, [0.0] * 12, 10)).count() == 12


def test_first_hidden_and_suffix(spark):
    bad = wells(spark, [(1, i, 0.0, 0.0, 0.0, 0.0, 0.0, None if i in (2, 4) else 1.0) for i in range(5)])
    assert S.first_hidden(bad).first()["is_suffix"] is False
    assert S.first_hidden(one(spark, [0.0] * 5, 3)).first()["is_suffix"] is True


def test_rolling_rejects_even_widths():
    with pytest.raises(ValueError):
        S.rolling("gr", 4)


CURVE = [(1, 0.0, 10.0), (1, 2.0, 20.0), (1, 2.0, 30.0), (1, 4.0, 5.0)]


@pytest.mark.parametrize("salts", [1, 3])
def test_interpolation_clamps_or_is_null_and_averages_repeated_places(spark, salts):
    c = spark.createDataFrame(CURVE, "k long, tvt double, gr double")
    q = spark.createDataFrame([(i, 1, v) for i, v in enumerate([-1.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0, None])] + [(99, 2, 1.0)], "id long, k long, at double")
    got = {r.id: r.looked_up for r in lookup.interpolate(q, c, "k", "at", salts=salts).collect()}
    assert got == {0: 10.0, 1: 10.0, 2: 17.5, 3: 25.0, 4: 15.0, 5: 5.0, 6: 5.0, 7: None, 99: None}
    inside = {r.id: r.looked_up for r in lookup.interpolate(q, c, "k", "at", clamp=False).collect()}
    assert inside[0] is None and inside[6] is None and inside[2] == 17.5
    near = {r.id: r.nearest_tvt for r in lookup.nearest_place(q, c, "k", "at").collect()}
    assert near[2] == 0.0 and near[4] == 2.0 and near[6] == 4.0


def test_knn_matches_brute_force_and_excludes(spark):
    rng = np.random.default_rng(3)
    p = np.round(np.concatenate([rng.normal(size=(150, 2)), rng.normal(size=(50, 2)) * 0.01 + 40]), 3)
    pts = spark.createDataFrame([(i, i % 7, float(x), float(y), float(i)) for i, (x, y) in enumerate(p)], "point_id long, w long, x double, y double, value double")
    q = np.round(np.concatenate([rng.normal(size=(40, 2)), [[500.0, 500.0], [40.0, 40.0]], p[:3]]), 3)
    qs = spark.createDataFrame([(i, i % 7, float(x), float(y)) for i, (x, y) in enumerate(q)], "query_id long, w long, x double, y double")
    got = {}
    for r in spatial.knn_join(qs, pts, 5, exclude=("w", "w")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.point_id))
    for i, (x, y) in enumerate(q):
        d = [(round(math.hypot(a - x, b - y), 9), j) for j, (a, b) in enumerate(p) if j % 7 != i % 7]
        assert [v for _, v in sorted(got[i])] == [j for _, j in sorted(d)[:5]]
    assert spatial.knn_join(qs, pts.limit(0), 5).count() == 0


@pytest.mark.parametrize("grouped", [True, False])
def test_knn_with_a_third_of_the_points_in_one_place(spark, monkeypatch, grouped):
    """A crowded place, a dense pad and a thin rest, with cells and blocks so small that all of them are split."""
    monkeypatch.setattr(spatial, "CELL_POINTS", 2)
    monkeypatch.setattr(spatial, "POINT_BLOCK", 40)
    monkeypatch.setattr(spatial, "QUERY_BLOCK", 30)
    rng = np.random.default_rng(5)
    p = np.round(np.concatenate([np.full((200, 2), 7.25), rng.normal(size=(200, 2)) * 0.01 + 3, rng.normal(size=(200, 2)) * 50]), 4)
    w = [0 if i % 3 else i % 9 for i in range(600)]
    pts = spark.createDataFrame([(i, w[i], float(x), float(y), float(i)) for i, (x, y) in enumerate(p)], "point_id long, w long, x double, y double, value double").repartition(6)
    chosen = [*range(0, 600, 7), 1, 2]
    qs = spark.createDataFrame([(i, w[i], *map(float, p[i])) for i in chosen] + [(9999, 0, -900.0, 900.0), (9998, 1, None, 1.0)], "query_id long, w long, x double, y double")
    got = {}
    for r in spatial.knn_join(qs, pts, 6, exclude=("w", "w") if grouped else None).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.point_id))
    assert set(got) == {*chosen, 9999}
    for i in got:
        (x, y), own = ((-900.0, 900.0), 0) if i == 9999 else (p[i], w[i])
        d = [(round(math.hypot(a - x, b - y), 9), j) for j, (a, b) in enumerate(p) if not grouped or w[j] != own]
        assert [v for _, v in sorted(got[i])] == [j for _, j in sorted(d)[:6]], i


def test_local_plane_recovers_a_plane_and_nulls_a_line(spark):
    pts = spark.createDataFrame([(i, float(i % 5), float(i // 5), 2.0 + 3 * (i % 5) - (i // 5)) for i in range(25)], "point_id long, x double, y double, value double")
    q = spark.createDataFrame([(0, 1.3, 2.2)], "query_id long, x double, y double")
    r = spatial.local_plane(spatial.knn_join(q, pts, 8), q).first()
    assert (r.plane, r.slope_x, r.slope_y) == pytest.approx((2 + 3.9 - 2.2, 3.0, -1.0))
    line = pts.where("y = 0")
    assert spatial.local_plane(spatial.knn_join(q, line, 5), q).first().plane is None


def test_gap_clusters_and_percent_ranks(spark):
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.0, 8.0, 16.1, 16.1, 30.0])], "g long, cand long, v double")
    got = {r.cand: r.cluster for r in ranking.gap_clusters(d, "g", "v", 8.0, "cand").collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}
    pct = {r.cand: r.v_pct for r in ranking.relative_features(d, "g", "v").collect()}
    assert pct[2] == pct[3] == pytest.approx(3.5 / 5)


def test_constant_groups_have_null_z_and_zero_correlation(spark):
    d = spark.createDataFrame([(1, i, 5.0, float(i)) for i in range(4)], "g long, cand long, v double, w double")
    assert all(r.v_z is None for r in ranking.relative_features(d, "g", "v").collect())
    assert tuple(A.correlations(d, "g", "v", "w").first()) == (1, 0.0, 0.0)


def test_contracts(spark):
    base = spark.createDataFrame([(1,), (2,)], "k long")
    side = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    with pytest.raises(Exception, match="repeated key"):
        contracts.sidecar(base, side, ["k"]).collect()
    assert contracts.sidecar(base, side.limit(1), ["k"]).count() == 2
    with pytest.raises(Exception, match="too small"):
        contracts.require(base, F.col("k") > 1, "too small").collect()
    with pytest.raises(ValueError):
        contracts.forbid(side, {"v"})
    got = {(r.k, r.problem) for r in contracts.coverage(base, spark.createDataFrame([(2,), (3,)], "k long"), "k").collect()}
    assert got == {(1, "missing"), (3, "unexpected")}


def test_out_of_fold_means_never_see_their_fold(spark):
    rows = [(i, i % 2, "a", float(i)) for i in range(10)]
    d = spark.createDataFrame(rows, "id long, fold int, by string, v double")
    before = {r.id: r.oof_mean for r in crossfit.out_of_fold_means(d, "id", "fold", "by", "v").collect()}
    moved = d.withColumn("v", F.when(F.col("fold") == 0, F.col("v") + 1000).otherwise(F.col("v")))
    after = {r.id: r.oof_mean for r in crossfit.out_of_fold_means(moved, "id", "fold", "by", "v").collect()}
    assert all(before[i] == after[i] for i, f, *_ in rows if f == 0) and all(before[i] != after[i] for i, f, *_ in rows if f == 1)


def test_balanced_folds(spark):
    d = spark.createDataFrame([(w, i) for w in range(10) for i in range(w + 1)], "w long, i long")
    sizes = crossfit.balanced_folds(d, "w", 5).groupBy("fold").agg(F.sum("n").alias("n")).collect()
    assert {r.n for r in sizes} == {11}


def test_results_do_not_depend_on_row_order(spark):
    from strataflow.operators import decode as D

    rng = np.random.default_rng(5)
    rows = [(w, i, float(i), float(i), 0.0, float(-i), float(rng.normal() * 20 + 60), 100.0 + i if i < 25 else None, 0) for w in range(3) for i in range(40)]
    cols = "well_id long, row_idx long, md double, x double, y double, z double, gr double, tvt_input double, curve_id long"
    curve = spark.createDataFrame([(0, float(t), float(60 + 20 * math.sin(t / 3))) for t in range(60, 180)], "curve_id long, tvt double, gr double")
    a = spark.createDataFrame(rows, cols)
    b = spark.createDataFrame(list(np.array(rows, object)[rng.permutation(len(rows))].tolist()), cols).repartition(3)
    for decode in (D.viterbi, D.beam, lambda w: D.filtered(w)[0]):
        x, y = (sorted(map(tuple, D.paths(D.pack(d, curve), decode).collect())) for d in (a, b))
        assert x == y and len(x) == 45


def test_numeric_looking_well_ids_stay_text(spark, tmp_path):
    d = spark.createDataFrame([("1234e567", 0, 1.0, 2.0, 3.0, 4.0, None, 5.0), ("00012345", 0, 1.0, 2.0, 3.0, 4.0, 9.0, None)], "well_id string, row_idx long, md double, x double, y double, z double, gr double, tvt_input double")
    io.write_logs(d, f"file://{tmp_path}/logs")
    assert sorted(map(tuple, io.scan_logs(spark, f"file://{tmp_path}/logs").collect())) == sorted(map(tuple, d.collect()))


def test_cache_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert io.cached(spark, build, f"file://{tmp_path}", v=1).count() == 3
    io.cached(spark, build, f"file://{tmp_path}", v=2)
    assert len(calls) == 2


def test_masked_copies_hide_answers(spark):
    d = one(spark, [0.0] * 5).withColumn("tvt", F.lit(1.0))
    m = io.masked(d, F.lit(2))
    assert "tvt" not in m.columns and m.where("tvt_input is not null").count() == 2


def test_streams(spark, tmp_path):
    from strataflow.streaming import filters

    rows = spark.range(40).select((F.col("id") % 2).alias("well_id"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.col("id").alias("event_id"), F.col("id").cast("double").alias("value"), F.lit("a").alias("event_type"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for name, build, mode in (("f", filters.exponential_filter, "append"), ("w", filters.windowed, "append")):
        q = build(stream()).writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("f").count() == 40 and spark.table("f").agg(F.max("n")).first()[0] == 20
    assert spark.table("w").count() > 0


def test_running_sums_and_tiles_match_a_plain_walk(spark):
    from strataflow.operators import order

    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(0, 4)), int(rng.integers(-5, 9))) for i in range(101)]
    d = spark.createDataFrame(rows, "id long, k int, v int").repartition(5)
    by = sorted(rows, key=lambda r: (-r[1], r[0]))
    got = {r.id: r for r in order.tile(order.running(d, [F.desc("k"), F.col("id")], {"s": F.col("v"), "n": F.lit(1)}), [F.desc("k"), F.col("id")], 7, "t").collect()}
    sizes = [101 // 7 + (i < 101 % 7) for i in range(7)]
    tiles = [t + 1 for t, n in enumerate(sizes) for _ in range(n)]
    total = 0
    for i, r in enumerate(by):
        assert (got[r[0]].s, got[r[0]].n, got[r[0]].t) == (total, i, tiles[i])
        total += r[2]
    few = order.tile(d.where("id < 3"), [F.col("id")], 7, "t")
    assert sorted((r.id, r.t) for r in few.collect()) == [(0, 1), (1, 2), (2, 3)]
    assert order.tile(d.where("id < 0"), [F.col("id")], 7, "t").count() == 0
