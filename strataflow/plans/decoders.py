"""Queries of the kernels that run well by well; they have no SQL twin and are held against plain loops in the tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataflow.kernels import filters as K
from strataflow.kernels import matching as M
from strataflow.kernels import segments as G
from strataflow.kernels import series as S
from strataflow.operators import chunks as H
from strataflow.operators import decode as D
from strataflow.operators import spatial as P
from strataflow.plans.proxies import CURVES, WELLS, curves, wells
from strataflow.plans.registry import query

R = lambda c, n=6: F.round(c, n)


def packed(spark, sf_dir):
    return D.pack(wells(spark, sf_dir), curves(spark, sf_dir), 20.0)


def _path_query(name, decode):
    @query(name)
    def q(spark, sf_dir):
        return D.paths(packed(spark, sf_dir), decode).select("well_id", "row_idx", R(F.col("value")).alias("level"))


_path_query("q10_grid_filter", D.grid_filter)
_path_query("q11_state_smoother", lambda w: D.state_smoother(w)["mean"])
_path_query("q14_viterbi", D.viterbi)
_path_query("q15_banded_decode", D.banded)
_path_query("q17_template_match", D.templates)
_path_query("q18_warp_path", D.warped)
_path_query("q19_dip_search", D.dips)
_path_query("q1_particle_filter", lambda w: D.filtered(w)[0])
_path_query("q2_velocity_filter", D.velocity_filter)
_path_query("w17_savgol", lambda w: S.savgol(w.gr[w.h :], 11, 3))
_path_query("w18_robust_polynomial", lambda w: S.robust_polynomial(w.hidden("md"), w.gr[w.h :], 4))
_path_query("w19_hinge_shape", lambda w: S.level_and_shape(w.hidden("md"), w.gr[w.h :])[1])
_path_query("x7a_rectified", lambda w: S.shrink_to_chord(S.rectify(D.viterbi(w), w.hidden("z")), w.hidden("z")))
_path_query("g3_piecewise_planes", lambda w: S.piecewise_planes(w.hidden("x"), w.hidden("y"), w.hidden("z"), 3.0).astype(float))


#: The wells made of events have some forty known and twenty hidden rows: smaller windows than the operators' own.
SHORT_WINDOW, SHORT_SEGMENT = 11, 8


def _chunked(name, run, kernel, column):
    @query(name)
    def q(spark, sf_dir):
        """Wells in chunks of sixteen rows, with a state carried from each to the next."""
        chunks = H.chunked(wells(spark, sf_dir), curves(spark, sf_dir), 20.0, size=16)
        return run(chunks, kernel()).select("well_id", "row_idx", R(F.col(column)).alias("level"))


_chunked("q10_chunked_filter", H.filter_wells, H.Grid, "level")
_chunked("q11_chunked_smoother", H.smooth_wells, H.States, "mean")


@query("c3_self_match_candidates")
def c3(spark, sf_dir):
    """Windows are shorter than the operator's own, as these wells have some forty known rows."""
    made = lambda w: D.self_matches(w, halves=(3, 5), bands=(20.0, 220.0), least=20, least_hidden=8, every=6)
    t = D.per_well(packed(spark, sf_dir), made, "well_id long, candidate string, row_idx long, value double")
    return t.select("well_id", "candidate", "row_idx", R(F.col("value")).alias("level"))


@query("q16_beam_search")
def q16(spark, sf_dir):
    """One path by each preset."""

    def kernel(w):
        if not w.usable:
            return None
        at = w.hidden("row_idx").astype(np.int64)
        return {"preset": np.repeat(list(M.BEAMS), len(at)), "row_idx": np.tile(at, len(M.BEAMS)), "level": np.concatenate([D.beam(w, p) for p in M.BEAMS])}

    t = D.per_well(packed(spark, sf_dir), kernel, "well_id long, preset string, row_idx long, level double")
    return t.select("well_id", "preset", "row_idx", R(F.col("level")).alias("level"))


@query("q12_level_smoother")
def q12(spark, sf_dir):
    def kernel(w):
        if not w.usable:
            return None
        s = D.level_smoother(w)
        return {"row_idx": w.hidden("row_idx").astype(np.int64), **{k: s[k] for k in ("mean", "std", "map", "q40", "q60")}}

    t = D.per_well(packed(spark, sf_dir), kernel, "well_id long, row_idx long, mean double, std double, map double, q40 double, q60 double")
    return t.select("well_id", "row_idx", *[R(F.col(c)).alias(c) for c in ("mean", "std", "map", "q40", "q60")])


@query("q25_five_decoders")
def q25(spark, sf_dir):
    def kernel(w):
        if not w.usable:
            return None
        levels = D.levels_of(w)
        return {"row_idx": w.hidden("row_idx").astype(np.int64), **M.five_decoders(D.misfit_map(w, levels), len(levels) // 2, levels, SHORT_WINDOW, 3)}

    names = ("argmin", "viterbi_10", "viterbi_05", "smooth", "dual")
    t = D.per_well(packed(spark, sf_dir), kernel, "well_id long, row_idx long, " + ", ".join(f"{n} double" for n in names))
    return t.select("well_id", "row_idx", *[R(F.col(c)).alias(c) for c in names])


#: Filters of a well, and those of a block.
SEEDS, BLOCK = 48, 8


def filters(calibrate=False):
    """A block of a well's filters of 400 particles, with their log-evidence."""
    return lambda w: D.filtered_block(w, BLOCK, calibrate=calibrate)


@query("q3_seed_ensemble")
def q3(spark, sf_dir):
    """Mean paths by evidence with the curve as it is and mapped half way to the signal, and both projected on a polynomial of level plus z."""

    def finish(e):
        ((level,), spread), ((calibrated,), _) = e["arms"]
        projected = [S.projected(e["md"], v + e["z"]) - e["z"] for v in (level, calibrated)]
        return {"row_idx": e["row_idx"].astype(np.int64), "seeds": e["seeds"], "level": level, "spread": spread, "calibrated": calibrated, "level_projected": projected[0], "calibrated_projected": projected[1]}

    names = ("level", "spread", "calibrated", "level_projected", "calibrated_projected")
    schema = "well_id long, row_idx long, seeds long, " + ", ".join(f"{n} double" for n in names)
    out = D.ensembles(packed(spark, sf_dir), SEEDS, BLOCK, [filters(), filters(True)], [5.0], finish, schema)
    return out.select("well_id", "row_idx", "seeds", *[R(F.col(c)).alias(c) for c in names])


@query("q5_scaled_ensembles")
def q5(spark, sf_dir):
    scales = [1.0, 5.0, 20.0]

    def finish(e):
        n = len(e["row_idx"])
        return {"row_idx": np.tile(e["row_idx"].astype(np.int64), len(scales)), "scale": np.repeat(scales, n), "level": e["arms"][0][0].ravel()}

    out = D.ensembles(packed(spark, sf_dir), SEEDS, BLOCK, [filters()], scales, finish, "well_id long, row_idx long, scale double, level double")
    return out.select("well_id", "row_idx", "scale", R(F.col("level")).alias("level"))


@query("q7_rate_bank")
def q7(spark, sf_dir):
    offsets = (-0.02, 0.0, 0.02)

    def kernel(w):
        if not w.usable:
            return None
        tried = [D.filtered(w, pull=w.rate + o) for o in offsets]
        weight = K.evidence_weights(np.array([e for _, e in tried]))
        best = int(weight.argmax())
        return {"row_idx": w.hidden("row_idx").astype(np.int64), "level": tried[best][0], "offset": offsets[best], "mixed": sum(x * p for x, (p, _) in zip(weight, tried, strict=True))}

    t = D.per_well(packed(spark, sf_dir), kernel, "well_id long, row_idx long, level double, offset double, mixed double")
    return t.select("well_id", "row_idx", R(F.col("level")).alias("level"), "offset", R(F.col("mixed")).alias("mixed"))


#: Spans of the hidden rows, offsets around each rate, largest rate.
SPANS = ((0.0, 1.0), (0.0, 0.25), (0.0, 0.5), (0.25, 0.75), (0.5, 1.0), (0.75, 1.0))
RATE_OFFSETS, RATE_CLIP = (-0.02, 0.0, 0.02), 0.2


def surface_rates(spark, sf_dir):
    """(well_id, rates): slopes along the well of the surface that planes through other wells' points give, by span of its hidden rows."""
    h = wells(spark, sf_dir)
    hidden = h.where("tvt_input is null").select("well_id", F.struct("well_id", "row_idx").alias("query_id"), "row_idx", "md", "n", "x", "y")
    cloud = h.select("well_id", F.struct("well_id", "row_idx").alias("point_id"), "x", "y", (F.col("tvt") + F.col("z")).alias("value"))
    sx, sy, extent = P.axis_scales(cloud)
    near = P.knn_join(hidden.select("query_id", "well_id", "x", "y"), cloud, 10, exclude=("well_id", "well_id"), sx=sx, sy=sy, extent=extent)
    s = P.local_plane(near, hidden.select("query_id", "x", "y"), weighted=False).select("query_id", "plane")
    rows = hidden.join(s, "query_id").where("plane is not null")
    place = (F.col("row_idx") - F.min("row_idx").over(W.partitionBy("well_id"))) / F.count(F.lit(1)).over(W.partitionBy("well_id"))
    rows = rows.withColumn("place", place)
    slopes = [F.regr_slope(F.when(F.col("place").between(a, b), F.col("plane")), F.when(F.col("place").between(a, b), F.col("md"))) for a, b in SPANS]
    return rows.groupBy("well_id").agg(F.array_compact(F.array(*slopes)).alias("rates"))


@query("x7b_surface_rate_bank")
def x7b(spark, sf_dir):
    """A filter for each rate of the well's own end and of the surface, and offsets; paths weighted by evidence, and the best one."""

    def kernel(w):
        if not w.usable:
            return None
        bank = [w.rate, *list(w.extra["rates"] if w.extra["rates"] is not None else [])[:4]]
        bank = np.unique(np.round(np.clip([r + o for r in bank for o in RATE_OFFSETS], -RATE_CLIP, RATE_CLIP), 6))
        tried = [D.filtered(w, particles=400, pull=float(r)) for r in bank]
        weight = K.evidence_weights(np.array([e for _, e in tried]))
        paths = np.array([p for p, _ in tried])
        return {"row_idx": w.hidden("row_idx").astype(np.int64), "level": weight @ paths, "best": paths[int(weight.argmax())], "rates": len(bank)}

    wide = packed(spark, sf_dir).join(surface_rates(spark, sf_dir), "well_id", "left")
    t = D.per_well(D.spread(wide, "well_id"), kernel, "well_id long, row_idx long, level double, best double, rates int")
    return t.select("well_id", "row_idx", R(F.col("level")).alias("level"), R(F.col("best")).alias("best"), "rates")


@query("q8_heat_map")
def q8(spark, sf_dir):
    t = D.per_well(packed(spark, sf_dir), D.heat_map, "well_id long, bin long, level double, prob double")
    return t.select("well_id", "bin", "level", R(F.col("prob")).alias("prob"))


@query(
    "q8_curve_powers",
    f"""WITH {WELLS}, {CURVES}, k AS (SELECT well_id, curve_id, arg_max(tvt_input, row_idx) AS l, count(tvt_input) AS h, count(*) AS n FROM h WHERE n > 0 GROUP BY ALL),
u AS (SELECT * FROM k WHERE l IS NOT NULL AND h >= 10 AND h < n),
f AS (SELECT well_id, row_idx, tvt_input, curve_id, gr FROM h WHERE tvt_input IS NOT NULL),
b AS (SELECT f.well_id, f.row_idx, f.gr, f.tvt_input, max(c.tvt) FILTER (WHERE c.tvt <= f.tvt_input) AS t0, min(c.tvt) FILTER (WHERE c.tvt >= f.tvt_input) AS t1, min(c.tvt) AS ta, max(c.tvt) AS tb, any_value(f.curve_id) AS curve_id
      FROM f JOIN c USING (curve_id) GROUP BY ALL),
p AS (SELECT well_id, b.gr, x.gr / 20.0 AS g0, y.gr / 20.0 AS g1, CASE WHEN y.tvt > x.tvt THEN (tvt_input - x.tvt) / (y.tvt - x.tvt) ELSE 0 END AS s
      FROM b JOIN c x ON x.curve_id = b.curve_id AND x.tvt = coalesce(t0, ta) JOIN c y ON y.curve_id = b.curve_id AND y.tvt = coalesce(t1, tb)),
q AS (SELECT well_id, CASE WHEN count(gr) >= 20 THEN least(greatest(stddev_pop(gr - (g0 + s * (g1 - g0))), 10), 60) ELSE 30 END AS sigma FROM p GROUP BY well_id),
o AS (SELECT h.well_id, row_idx, gr, u.curve_id, l, coalesce(sigma, 30) AS sigma FROM h JOIN u USING (well_id) LEFT JOIN q USING (well_id) WHERE tvt_input IS NULL),
d AS (SELECT o.well_id, row_idx, -0.5 * pow((o.gr - c.gr / 20.0) / sigma, 2) AS e FROM o JOIN c ON c.curve_id = o.curve_id AND abs(c.tvt - l) <= 60 WHERE o.gr IS NOT NULL),
m AS (SELECT *, exp(e - max(e) OVER (PARTITION BY well_id, row_idx)) AS x FROM d),
r AS (SELECT *, x / sum(x) OVER (PARTITION BY well_id, row_idx) AS p FROM m),
a AS (SELECT well_id, row_idx, greatest(max(p), sum(p * p)) AS alone, 1 + sum(p * ln(greatest(p, 1e-300))) / ln(count(*)) AS told FROM r GROUP BY ALL HAVING count(*) >= 4)
SELECT o.well_id, o.row_idx, round(CASE WHEN alone IS NULL THEN 1 ELSE 0.35 + 0.65 * least(alone, 1) END, 5) AS ambiguity,
 round(CASE WHEN told IS NULL THEN 1 ELSE least(greatest(told / 0.75, 0.75), 1.25) END, 5) AS information
FROM o LEFT JOIN a USING (well_id, row_idx)""",
)
def q8_powers(spark, sf_dir):
    """How far each hidden row's observation counts, by a scan of the curve around the last known level."""
    t = D.per_well(packed(spark, sf_dir), D.powers, "well_id long, row_idx long, ambiguity double, information double")
    return t.select("well_id", "row_idx", R(F.col("ambiguity"), 5).alias("ambiguity"), R(F.col("information"), 5).alias("information"))


@query("q9_block_merge", f"""WITH {WELLS} SELECT well_id, row_idx // 4 AS block, max(md) AS md, round(avg(z), 6) + 0.0 AS z, round(avg(gr), 6) AS gr, round(pow(count(gr) / 4.0, 0.5), 6) AS power FROM h WHERE tvt_input IS NULL GROUP BY ALL""")
def q9(spark, sf_dir):
    h = wells(spark, sf_dir).where("tvt_input is null")
    return h.groupBy("well_id", F.floor(F.col("row_idx") / 4).cast("long").alias("block")).agg(F.max("md").alias("md"), R(F.avg("z")).alias("z"), R(F.avg("gr")).alias("gr"), R(F.pow(F.count("gr") / 4.0, F.lit(0.5))).alias("power"))


@query("q13_pseudo_curve")
def q13(spark, sf_dir):
    return D.per_well(packed(spark, sf_dir), D.pseudo_curve, D.PATH).select("well_id", "row_idx", R(F.col("value")).alias("gr"))


@query("q20_dip_spectrum")
def q20(spark, sf_dir):
    def kernel(w):
        if not w.usable:
            return None
        dip, spread, peaks = M.dip_spectrum(w.hidden("md"), w.hidden("z"), w.gr[w.h :], w.curve, w.level)
        return {"dip": [dip], "spread": [spread], "peaks": [peaks]}

    t = D.per_well(packed(spark, sf_dir), kernel, "well_id long, dip double, spread double, peaks int")
    return t.select("well_id", R(F.col("dip")).alias("dip"), R(F.col("spread")).alias("spread"), "peaks")


@query("q22_path_evidence")
def q22(spark, sf_dir):
    t = D.per_well(packed(spark, sf_dir), lambda w: D.evidence_of_path(w, D.viterbi(w)) if w.usable else None, "well_id long, rms double, corr double, warp_rms double")
    return t.select("well_id", *[R(F.col(c)).alias(c) for c in ("rms", "corr", "warp_rms")])


@query("q23_segment_posterior")
def q23(spark, sf_dir):
    """Nine candidates by well, put together by segments and moved to from the lattice path; the curves' formations are of ten levels each."""

    def kernel(w):
        if not w.usable:
            return None
        base = D.viterbi(w)
        paths = np.array([*(np.full(len(w.dm), w.level + o) for o in (-12.0, -6.0, 0.0, 6.0, 12.0)), base, D.viterbi(w, 0.10), D.banded(w), D.beam(w)])
        scores = -np.sqrt((((w.gr[w.h :][None, :] - w.curve(paths)) / w.sigma) ** 2).mean(axis=1))
        formation = np.floor((w.curve_t - 76) / 10)
        path = G.blended_path(paths, scores, w.curve_t, formation, formation, SHORT_SEGMENT)
        level, made = G.moved(base, path, scores)
        return {"row_idx": w.hidden("row_idx").astype(np.int64), "posterior": path, "level": level, "moved": np.full(len(level), made)}

    t = D.per_well(packed(spark, sf_dir), kernel, "well_id long, row_idx long, posterior double, level double, moved boolean")
    return t.select("well_id", "row_idx", R(F.col("posterior")).alias("posterior"), R(F.col("level")).alias("level"), "moved")


@query("q26_prefix_replay")
def q26(spark, sf_dir):
    t = D.per_well(packed(spark, sf_dir), D.replay, "well_id long, n int, rmse double, persistence double")
    return t.select("well_id", "n", R(F.col("rmse")).alias("rmse"), R(F.col("persistence")).alias("persistence"))


@query("w22_self_correlation")
def w22(spark, sf_dir):
    def kernel(w):
        lag, r = S.self_correlation(w.gr, 12, range(4, 30))
        return {"lag": [lag], "r": [r]}

    return D.per_well(packed(spark, sf_dir), kernel, "well_id long, lag int, r double").select("well_id", "lag", R(F.col("r")).alias("r"))
