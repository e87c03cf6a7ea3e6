"""Queries that put candidates, evidence and risk reports together."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.functions import columns as C
from strataflow.operators import lookup as L
from strataflow.operators import ranking as K
from strataflow.operators import sequence as S
from strataflow.operators.order import tile
from strataflow.plans.proxies import PREDICTIONS, SCORED, WELLS, curves, predictions, scored, wells
from strataflow.plans.registry import query
from strataflow.tables import table

R = lambda c, n=6: F.round(c, n)
BAD = "g AS (SELECT well, sqrt(avg((pred - y) * (pred - y))) AS rmse, avg(pred) AS level, count(*) AS n FROM p GROUP BY well)"


def by_well(spark, sf_dir):
    e = F.col("pred") - F.col("y")
    return predictions(spark, sf_dir).groupBy("well").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg("pred").alias("level"), F.count(F.lit(1)).alias("n"))


@query("a24_threshold_sensitivity", f"WITH {PREDICTIONS}, {BAD} SELECT t AS threshold, count(*) FILTER (WHERE rmse > t) AS bad, round(avg(CASE WHEN rmse > t THEN 1.0 ELSE 0.0 END), 6) AS share FROM g, (SELECT unnest([38000, 39000, 40000, 41000, 42000]::DOUBLE[]) AS t) GROUP BY t")
def sensitivity(spark, sf_dir):
    t = F.explode(F.array(*[F.lit(float(x)) for x in (38000, 39000, 40000, 41000, 42000)]))
    bad = F.col("rmse") > F.col("threshold")
    return by_well(spark, sf_dir).withColumn("threshold", t).groupBy("threshold").agg(F.count_if(bad).alias("bad"), R(F.avg(F.when(bad, 1.0).otherwise(0.0))).alias("share"))


@query("a24_interactions", f"""WITH {PREDICTIONS}, {BAD}, q AS (SELECT *, CAST(ntile(3) OVER (ORDER BY level, well) AS INTEGER) AS a, CAST(ntile(3) OVER (ORDER BY n, well) AS INTEGER) AS b FROM g)
SELECT a, b, count(*) AS n, round(avg(rmse), 4) AS rmse FROM q GROUP BY a, b""")
def interactions(spark, sf_dir):
    q = tile(tile(by_well(spark, sf_dir), [F.col("level"), F.col("well")], 3, "a"), [F.col("n"), F.col("well")], 3, "b")
    return q.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), R(F.avg("rmse"), 4).alias("rmse"))


@query(
    "a24_bootstrap",
    f"""WITH {PREDICTIONS}, {BAD}, u AS (SELECT draw, rmse, {C.hash_unit_sql('well', 'draw')} AS u FROM g, (SELECT unnest(range(100)) AS draw)),
k AS (SELECT draw, rmse, CASE WHEN u < 0.3679 THEN 0 WHEN u < 0.7358 THEN 1 WHEN u < 0.9197 THEN 2 WHEN u < 0.9810 THEN 3 ELSE 4 END AS k FROM u),
d AS (SELECT draw, sum(k * rmse) / sum(k) AS mean FROM k GROUP BY draw)
SELECT round(avg(mean), 4) AS mean, round(quantile_cont(mean, 0.05), 4) AS low, round(quantile_cont(mean, 0.95), 4) AS high FROM d""",
)
def bootstrap(spark, sf_dir):
    """Spread of the mean error over resampled wells; each draw's counts come from a hash, one for each well and draw."""
    g = by_well(spark, sf_dir).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(99))))
    u = C.hash_unit("well", "draw")
    times = F.when(u < 0.3679, 0).when(u < 0.7358, 1).when(u < 0.9197, 2).when(u < 0.9810, 3).otherwise(4)
    d = g.withColumn("k", times).groupBy("draw").agg((F.sum(F.col("k") * F.col("rmse")) / F.sum("k")).alias("mean"))
    return d.agg(R(F.avg("mean"), 4).alias("mean"), R(F.percentile("mean", F.lit(0.05)), 4).alias("low"), R(F.percentile("mean", F.lit(0.95)), 4).alias("high"))


def pool(spark, sf_dir):
    """Candidate levels of every well at its hidden rows, by family: grid, rate, contact."""
    h = S.anchors(wells(spark, sf_dir), "tvt_input", "md").where("last_md is not null")
    known = h.where("tvt_input is not null")
    u = F.col("tvt_input") + F.col("z")
    fit = known.groupBy("well_id").agg(F.regr_slope(u, F.col("md")).alias("rate"), F.median(u).alias("surface"), F.max_by(u, "row_idx").alias("u0"))
    rows = h.where("tvt_input is null").join(fit, "well_id")
    since = F.col("md") - F.col("last_md")
    options = [F.struct(F.lit("grid").alias("family"), F.lit(float(o)).alias("option"), (F.col("last_tvt_input") + o).alias("level")) for o in (-18, -12, -6, 0, 6, 12, 18)]
    options += [F.struct(F.lit("rate").alias("family"), F.lit(o).alias("option"), (F.col("u0") + (F.coalesce("rate", F.lit(0.0)) + o) * since - F.col("z")).alias("level")) for o in (-0.012, 0.0, 0.012)]
    options.append(F.struct(F.lit("contact").alias("family"), F.lit(0.0).alias("option"), (F.col("surface") - F.col("z")).alias("level")))
    return rows.withColumn("o", F.explode(F.array(*options))).select("well_id", "curve_id", "row_idx", "gr", "o.*")


@query("c10_candidate_pool")
def c10(spark, sf_dir):
    p = L.interpolate(pool(spark, sf_dir), curves(spark, sf_dir), "curve_id", "level", salts=4)
    r = F.col("gr") - F.col("looked_up") / 20.0
    c = p.groupBy("well_id", "family", "option").agg(F.sqrt(F.avg(r * r)).alias("rms"), F.avg("level").alias("delta"), F.count("gr").alias("n"))
    c = c.withColumns({"score": -F.col("rms"), "cand": F.concat_ws(":", "family", F.col("option").cast("string"))})
    return K.diverse(c, "well_id", 2, 1, 6.0, 6).select("well_id", "cand", "kept_rank", R(F.col("rms")).alias("rms"), R(F.col("delta")).alias("level"))


@query("c13_member_scores")
def c13(spark, sf_dir):
    from strataflow.operators import crossfit as X
    from strataflow.operators.learning import out_of_fold

    s = K.relative_features(scored(spark, sf_dir), "grp", "score").withColumn("truth", F.exp(-F.abs("delta") / 12.0))
    t = out_of_fold(s, "grp", X.modulo_folds(s, "grp", 3), ["score", "score_z", "score_pct"], "truth", "forest", 3)
    return t.select("grp", "cand", "fold", R(F.col("prediction")).alias("member_score"))


@query(
    "c16_disagreement",
    f"""WITH {PREDICTIONS}, a AS (SELECT well, row, pred AS a, 30000.0::DOUBLE AS b, pred * 0.5 + 15000.0 AS c FROM p), m AS (SELECT *, (a + b + c) / 3 AS mean, greatest(a, b, c) - least(a, b, c) AS spread FROM a),
g AS (SELECT well, avg(spread) AS group_spread, round(avg(abs(a - mean)), 6) AS da, round(avg(abs(b - mean)), 6) AS db, round(avg(abs(c - mean)), 6) AS dc FROM m GROUP BY well)
SELECT well, row, round(spread, 4) AS spread, round(mean, 4) AS mean, round(sqrt(((a - mean) * (a - mean) + (b - mean) * (b - mean) + (c - mean) * (c - mean)) / 3), 4) AS std, round(mean - a, 4) + 0.0 AS move,
  round((CASE WHEN b > a THEN 1 ELSE 0 END + CASE WHEN c > a THEN 1 ELSE 0 END) / 3.0, 4) AS above, round(group_spread, 4) AS group_spread,
  CASE WHEN da <= db AND da <= dc THEN 'a' WHEN db <= dc THEN 'b' ELSE 'c' END AS central FROM m JOIN g USING (well)""",
)
def c16(spark, sf_dir):
    from strataflow.operators.candidates import disagreement

    arms = {"a": F.col("pred"), "b": F.lit(30000.0), "c": F.col("pred") * 0.5 + 15000.0}
    d = disagreement(predictions(spark, sf_dir).withColumns(arms), list(arms), "a", "well")
    return d.select("well", "row", *[(R(F.col(c), 4) + 0.0).alias(c) for c in ("spread", "mean", "std", "move", "above", "group_spread")], "central")


@query("g2_trend_blocks")
def g2(spark, sf_dir):
    """Simulated trends: blocks of increments, each taken from a place of the same well that a hash names."""
    h = wells(spark, sf_dir).withColumn("d", S.difference("tvt")).withColumns({"block": F.floor(F.col("row_idx") / 8), "at": F.col("row_idx") % 8})
    blocks = F.ceil(F.col("n") / 8)
    source = h.select("well_id", F.col("block").alias("source"), "at", "d")
    target = h.select("well_id", "row_idx", "block", "at", F.pmod(F.xxhash64("well_id", "block"), blocks).alias("source"))
    j = target.join(source, ["well_id", "source", "at"], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    return j.select("well_id", "row_idx", R(F.sum("d").over(S.so_far())).alias("trend"))


@query("s12_manifest", "SELECT 'orders' AS name, count(*) AS rows, sum(o_orderkey)::VARCHAR AS key_sum FROM orders UNION ALL SELECT 'customer', count(*), sum(c_custkey)::VARCHAR FROM customer")
def s12(spark, sf_dir):
    part = lambda n, k: table(spark, sf_dir, n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows"), F.sum(k).cast("string").alias("key_sum"))
    return part("orders", "o_orderkey").unionByName(part("customer", "c_custkey"))


@query("q6_batched_seeds")
def q6(spark, sf_dir):
    """All seeds of a well in one vectorised batch of filters; the same seeds as one by one give the same spread of paths."""
    from strataflow.kernels import filters as N
    from strataflow.operators import decode as D

    def kernel(w):
        if not w.usable:
            return None
        path, evidence = N.particle_filters(w.dm, w.hidden("z"), w.hidden("gr"), w.curve, w.sigma, w.level, w.rows["z"][w.h - 1], w.rate, [N.seed_of(w.well_id, i) for i in range(48)], 400)
        weight = N.evidence_weights(evidence)
        return {"row_idx": w.hidden("row_idx").astype("int64"), "value": weight @ path}

    return D.per_well(D.pack(wells(spark, sf_dir), curves(spark, sf_dir), 20.0), kernel, D.PATH).select("well_id", "row_idx", R(F.col("value")).alias("level"))


@query("w14_cluster_margins", f"WITH {SCORED}, c AS (SELECT grp, family, max(score) AS s FROM k GROUP BY grp, family), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY s DESC, family) AS r FROM c) SELECT grp, max(s) FILTER (WHERE r = 1) - coalesce(max(s) FILTER (WHERE r = 2), max(s) FILTER (WHERE r = 1)) AS margin FROM r GROUP BY grp")
def margins(spark, sf_dir):
    c = scored(spark, sf_dir).groupBy("grp", "family").agg(F.max("score").alias("s"))
    r = K.top_k(c, "grp", 2, F.desc("s"), F.asc("family"))
    best, second = F.max(F.when(F.col("rank") == 1, F.col("s"))), F.max(F.when(F.col("rank") == 2, F.col("s")))
    return r.groupBy("grp").agg((best - F.coalesce(second, best)).alias("margin"))


@query("p5_level_by_well", f"WITH {WELLS} SELECT well_id, round(avg(tvt), 6) AS level, round(max(tvt) - min(tvt), 6) AS span FROM h GROUP BY well_id")
def p5_level(spark, sf_dir):
    return wells(spark, sf_dir).groupBy("well_id").agg(R(F.avg("tvt")).alias("level"), R(F.max("tvt") - F.min("tvt")).alias("span"))
