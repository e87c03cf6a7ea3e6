"""Queries of candidate ranking, clustering, posteriors, folds and text-coded names."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataflow.functions import columns as C
from strataflow.operators import crossfit as X
from strataflow.operators import ranking as K
from strataflow.plans.proxies import PREDICTIONS, SCORED, WELLS, predictions, scored, wells
from strataflow.plans.registry import query
from strataflow.tables import table

R = lambda c, n=6: F.round(c, n)
CL = f"""{SCORED}, n AS (SELECT *, CASE WHEN delta - lag(delta) OVER w > 8 THEN 1 ELSE 0 END AS nw FROM k WINDOW w AS (PARTITION BY grp ORDER BY delta, cand)),
cl AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY grp ORDER BY delta, cand ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cluster FROM n)"""
SM = f"{SCORED}, mx AS (SELECT *, exp((score - max(score) OVER (PARTITION BY grp)) / 200.0) AS e FROM k), sm AS (SELECT *, e / sum(e) OVER (PARTITION BY grp) AS p FROM mx)"


@query("w10_relative_features", f"""WITH {SCORED} SELECT grp, cand, round(CASE WHEN stddev_pop(score) OVER g > 0 THEN (score - avg(score) OVER g) / stddev_pop(score) OVER g END, 5) + 0.0 AS z,
 round((rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2.0) / count(*) OVER g, 6) AS pct,
 round((count(*) OVER g + 1 - (rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2.0)) / count(*) OVER g, 6) AS pct_desc FROM k WINDOW g AS (PARTITION BY grp)""")
def w10(spark, sf_dir):
    t = K.relative_features(scored(spark, sf_dir), "grp", "score")
    return t.select("grp", "cand", R(F.col("score_z"), 5).alias("z"), R(F.col("score_pct")).alias("pct"), R(F.col("score_pct_desc")).alias("pct_desc"))


@query("w11_percentile_cost", f"WITH {SCORED} SELECT grp, cand, round((row_number() OVER (PARTITION BY grp ORDER BY score, cand) - 1) / greatest(count(*) OVER (PARTITION BY grp) - 1, 1), 6) AS cost FROM k")
def w11(spark, sf_dir):
    return scored(spark, sf_dir).select("grp", "cand", R(K.percentile_cost("grp", "score", "cand")).alias("cost"))


@query("w12_gap_clusters", f"WITH {CL} SELECT grp, cand, cluster FROM cl")
def w12(spark, sf_dir):
    return K.gap_clusters(scored(spark, sf_dir), "grp", "delta", 8.0, "cand").select("grp", "cand", "cluster")


@query("a22_cluster_table", f"""WITH {CL} SELECT grp, cluster, count(*) AS n, round(avg(delta), 5) + 0.0 AS delta_mean, round(stddev_pop(delta), 4) AS delta_std, min(delta) AS delta_min, max(delta) AS delta_max,
 round(max(delta) - min(delta), 5) AS delta_span, round(avg(score), 5) AS score_mean, min(score) AS score_low, max(score) AS score_high FROM cl GROUP BY grp, cluster""")
def a22(spark, sf_dir):
    t = K.cluster_table(K.gap_clusters(scored(spark, sf_dir), "grp", "delta", 8.0, "cand"), "grp", ["score"])
    return t.select("grp", "cluster", "n", R(F.col("delta_mean"), 5).alias("delta_mean"), R(F.col("delta_std"), 4).alias("delta_std"), "delta_min", "delta_max", R(F.col("delta_span"), 5).alias("delta_span"), R(F.col("score_mean"), 5).alias("score_mean"), "score_low", "score_high")


@query("w13_top_k", f"WITH {SCORED}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY score DESC, family, cand) AS INTEGER) AS rank FROM k) SELECT grp, rank, cand, score FROM r WHERE rank <= 3")
def w13(spark, sf_dir):
    return K.top_k(scored(spark, sf_dir), "grp", 3, F.desc("score"), F.asc("family"), F.asc("cand")).select("grp", "rank", "cand", "score")


@query("w14_confidence", f"""WITH {SM}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, cand) AS rk FROM sm)
SELECT grp, round(max(p), 6) AS top_prob, coalesce(max(CASE WHEN rk = 1 THEN score END) - max(CASE WHEN rk = 2 THEN score END), 0) AS margin,
 round(CASE WHEN count(*) > 1 THEN -sum(p * ln(greatest(p, 1e-300))) / ln(count(*)) ELSE 0 END, 6) AS entropy, count(*) AS n FROM r GROUP BY grp""")
def w14(spark, sf_dir):
    t = K.confidence(scored(spark, sf_dir), "grp", "score", 200.0)
    return t.select("grp", R(F.col("top_prob")).alias("top_prob"), "margin", R(F.col("entropy")).alias("entropy"), "n")


@query("w15_softmax", f"WITH {SM} SELECT grp, cand, round(p, 8) AS p FROM sm")
def w15(spark, sf_dir):
    return K.posterior(scored(spark, sf_dir), "grp", "score", 200.0).select("grp", "cand", R(F.col("weight"), 8).alias("p"))


@query("w16_robust_z", f"""WITH {SCORED}, m AS (SELECT grp, median(score) AS m FROM k GROUP BY grp), d AS (SELECT k.*, m, abs(score - m) AS d FROM k JOIN m USING (grp)), q AS (SELECT grp, median(d) * 1.4826 AS mad FROM d GROUP BY grp)
SELECT grp, cand, round(CASE WHEN mad > 1e-9 THEN (score - m) / mad ELSE 0 END, 6) + 0.0 AS rz FROM d JOIN q USING (grp)""")
def w16(spark, sf_dir):
    return K.robust_z(scored(spark, sf_dir), "grp", "score").select("grp", "cand", R(F.col("score_rz")).alias("rz"))


@query("w24_top_share_jaccard", f"""WITH {SCORED}, q AS (SELECT grp, quantile_cont(abs(delta), 0.7) AS qa, quantile_cont(abs(score), 0.7) AS qb FROM k GROUP BY grp), m AS (SELECT k.grp, abs(delta) >= qa AS a, abs(score) >= qb AS b FROM k JOIN q USING (grp))
SELECT grp, round(CASE WHEN count(*) FILTER (WHERE a OR b) > 0 THEN count(*) FILTER (WHERE a AND b) / count(*) FILTER (WHERE a OR b) ELSE 0 END, 6) AS jaccard FROM m GROUP BY grp""")
def w24(spark, sf_dir):
    a = K.top_share(scored(spark, sf_dir), "grp", "delta", 0.3).withColumnRenamed("in_top", "a")
    b = K.top_share(a, "grp", "score", 0.3).withColumnRenamed("in_top", "b")
    return K.jaccard_masks(b, "grp", "a", "b").select("grp", R(F.col("jaccard")).alias("jaccard"))


@query("c7_unique_candidates", "SELECT min(p_partkey) AS cand, p_brand, p_size FROM part GROUP BY p_brand, p_size")
def c7(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("digest", F.md5(F.concat_ws("|", "p_brand", F.col("p_size").cast("string")).cast("binary")))
    return p.groupBy("digest").agg(F.min("p_partkey").alias("cand"), F.min_by("p_brand", "p_partkey").alias("p_brand"), F.min_by("p_size", "p_partkey").alias("p_size")).drop("digest")


@query("c8_diverse_keep", f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, cand) AS a, row_number() OVER (PARTITION BY grp, family ORDER BY score DESC, cand) AS f,
 row_number() OVER (PARTITION BY grp, floor(delta / 6) ORDER BY score DESC, cand) AS b FROM k), t AS (SELECT *, CASE WHEN a <= 3 THEN 0 WHEN f <= 1 THEN 1 WHEN b = 1 THEN 2 WHEN b = 2 THEN 3 ELSE 4 END AS tier FROM r),
 q AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY tier, a) AS kept FROM t) SELECT grp, cand, tier, CAST(kept AS INTEGER) AS kept_rank FROM q WHERE kept <= 8""")
def c8(spark, sf_dir):
    return K.diverse(scored(spark, sf_dir), "grp", 3, 1, 6.0, 8).select("grp", "cand", "tier", "kept_rank")


@query("c9_shape_key", f"WITH {SCORED} SELECT cand, CAST(round_even(delta / 4, 0) AS BIGINT) || ':' || CAST(round_even(score / 50, 0) AS BIGINT) AS shape FROM k")
def c9(spark, sf_dir):
    b = lambda c, w: F.bround(F.col(c) / w, 0).cast("long").cast("string")
    return scored(spark, sf_dir).select("cand", F.concat_ws(":", b("delta", 4), b("score", 50)).alias("shape"))


@query("c1_level_grid", f"""WITH {WELLS}, a AS (SELECT well_id, arg_max(tvt_input, row_idx) AS l, arg_max(md, row_idx) AS m FROM h WHERE tvt_input IS NOT NULL GROUP BY well_id)
SELECT well_id, kind, o AS "offset", count(*) AS n, round(avg(CASE WHEN kind = 'const' THEN l + o ELSE l + o * (row_idx - (n0 * 6 + 9) // 10) / 10.0 END), 5) AS level
FROM (SELECT h.well_id, row_idx, n AS n0, l FROM h JOIN a USING (well_id) WHERE tvt_input IS NULL), (SELECT unnest([-36.0,-24,-18,-12,-6,6,12,18,24,36]::DOUBLE[]) AS o), (SELECT unnest(['const','ramp']) AS kind) GROUP BY ALL""")
def c1(spark, sf_dir):
    from strataflow.operators.sequence import anchors

    h = anchors(wells(spark, sf_dir), "tvt_input").where("tvt_input is null and last_tvt_input is not null")
    fan = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(float(s * o)).alias("offset")) for k in ("const", "ramp") for o in (6, 12, 18, 24, 36) for s in (-1, 1)])
    c = h.withColumn("c", F.explode(fan)).select("*", "c.kind", "c.offset")
    ramp = F.col("offset") * (F.col("row_idx") - F.floor((F.col("n") * 6 + 9) / 10)) / 10.0
    level = F.col("last_tvt_input") + F.when(F.col("kind") == "const", F.col("offset")).otherwise(ramp)
    return c.groupBy("well_id", "kind", "offset").agg(F.count(F.lit(1)).alias("n"), R(F.avg(level), 5).alias("level"))


@query("c14_posterior_mean", f"WITH {SM} SELECT grp, round(sum(p * delta), 6) + 0.0 AS level FROM sm GROUP BY grp")
def c14(spark, sf_dir):
    p = K.posterior(scored(spark, sf_dir), "grp", "score", 200.0)
    return p.groupBy("grp").agg(R(F.sum(F.col("weight") * F.col("delta"))).alias("level"))


@query("c15_gate", f"""WITH {SM}, g AS (SELECT grp, max(p) AS t, CASE WHEN count(*) > 1 THEN -sum(p * ln(greatest(p, 1e-300))) / ln(count(*)) ELSE 0 END AS en, sum(p * delta) AS mv FROM sm GROUP BY grp)
SELECT grp, en <= 0.9 AND abs(mv) <= 10 AND t >= 0.05 AS passes FROM g""")
def c15(spark, sf_dir):
    s = scored(spark, sf_dir)
    p = K.posterior(s, "grp", "score", 200.0).groupBy("grp").agg(F.sum(F.col("weight") * F.col("delta")).alias("move"))
    j = K.confidence(s, "grp", "score", 200.0).join(p, "grp")
    return j.select("grp", K.gate(F.col("entropy"), F.col("move"), F.col("top_prob"), 0.9, 10.0, 0.05).alias("passes"))


@query("c18_routing_code", f"WITH {WELLS}, s AS (SELECT well_id, count(*) - count(tvt_input) AS n, max(z) - min(z) AS span FROM h GROUP BY well_id) SELECT well_id, CASE WHEN n > 25 THEN 1 ELSE 0 END + 2 * (CASE WHEN span < 30 THEN 0 WHEN span < 40 THEN 1 ELSE 2 END) AS code FROM s")
def c18(spark, sf_dir):
    s = wells(spark, sf_dir).groupBy("well_id").agg((F.count(F.lit(1)) - F.count("tvt_input")).alias("n"), (F.max("z") - F.min("z")).alias("span"))
    return s.select("well_id", ((F.col("n") > 25).cast("int") + F.when(F.col("span") < 30, 0).when(F.col("span") < 40, 2).otherwise(4)).alias("code"))


@query("c19_safety_router", f"""WITH {SCORED}, s AS (SELECT grp, avg(abs(delta)) AS d, quantile_cont(abs(delta), 0.1) AS q10, avg(score) AS a FROM k GROUP BY grp)
SELECT grp, d < 20 AND q10 < 6 AS safe, round(CASE WHEN d < 20 AND q10 < 6 THEN (0.25 * a + 0.25 * d + 1 * q10) / 1.5 ELSE (a + 0.5 * d) / 1.5 END, 5) AS blend FROM s""")
def c19(spark, sf_dir):
    # summed in the order of the rows, as SQL does: means on a limit, or half way between two digits, hang on the last bit
    run = F.sum(F.abs("delta")).over(W.partitionBy("grp").orderBy("cand").rowsBetween(W.unboundedPreceding, 0))
    d = F.max("run") / F.count("delta")
    s = scored(spark, sf_dir).withColumn("run", run).groupBy("grp").agg(d.alias("d"), F.percentile(F.abs("delta"), F.lit(0.1)).alias("q10"), F.avg("score").alias("a"))
    safe = (F.col("d") < 20) & (F.col("q10") < 6)
    blend = F.when(safe, (0.25 * F.col("a") + 0.25 * F.col("d") + F.col("q10")) / 1.5).otherwise((F.col("a") + 0.5 * F.col("d")) / 1.5)
    return s.select("grp", safe.alias("safe"), C.round_scaled(blend, 5).alias("blend"))


@query("q4_mode_summary", f"""WITH {SM}, b AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY grp ORDER BY delta, cand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(p) OVER (PARTITION BY grp) AS before FROM sm)
SELECT grp, CAST(least(floor(before * 3), 2) AS INTEGER) AS mode, round(sum(p * delta) / sum(p), 4) + 0.0 AS level, round(sum(p), 6) AS mass FROM b GROUP BY ALL""")
def q4(spark, sf_dir):
    p = K.posterior(scored(spark, sf_dir), "grp", "score", 200.0)
    return K.mode_summary(p, "grp", "delta", "weight", 3).select("grp", "mode", R(F.col("level"), 4).alias("level"), R(F.col("mass")).alias("mass"))


@query("q21_two_minima", f"""WITH {SCORED}, b AS (SELECT grp, min((score, delta)) AS b FROM k GROUP BY grp), j AS (SELECT k.*, b[2] AS s, b[1] AS c FROM k JOIN b USING (grp))
SELECT grp, any_value(s) AS shift, any_value(c) AS cost, arg_min(delta, (score, delta)) FILTER (WHERE abs(delta - s) BETWEEN 5 AND 30) AS shift2, min(score) FILTER (WHERE abs(delta - s) BETWEEN 5 AND 30) AS cost2 FROM j GROUP BY grp""")
def q21(spark, sf_dir):
    return K.second_minimum(scored(spark, sf_dir), "grp", "delta", "score", 5.0, 30.0)


@query("q24_soft_level", f"""WITH {SM}, l AS (SELECT grp, sum(p * delta) AS m, CASE WHEN count(*) > 1 THEN -sum(p * ln(greatest(p, 1e-300))) / ln(count(*)) ELSE 0 END AS en, sum(CASE WHEN delta > 0 THEN p ELSE 0 END) AS up FROM sm GROUP BY grp)
SELECT grp, round(CASE WHEN en <= 0.9 AND abs(m) >= 1 AND greatest(up, 1 - up) >= 0.75 THEN 0.9 * greatest(-4, least(4, m)) ELSE 0 END, 6) + 0.0 AS move FROM l""")
def q24(spark, sf_dir):
    from strataflow.operators.posterior import trusted_level

    return trusted_level(scored(spark, sf_dir), "grp", "score", "delta", 200.0).select("grp", R(F.col("move")).alias("move"))


@query("p13_soft_utility", f"WITH {SCORED} SELECT cand, round(exp(-abs(delta) / 12), 9) AS u FROM k")
def p13(spark, sf_dir):
    return scored(spark, sf_dir).select("cand", R(C.soft_utility(F.abs("delta"), 12.0), 9).alias("u"))


@query("p14_ramped_move", f"WITH {WELLS} SELECT well_id, row_idx, round(tvt + greatest(-12, least(12, 0.64 * (1 - exp(-row_idx / greatest(80.0, 0.12 * n))) * (tvt + 40 - tvt))), 6) AS v FROM h")
def p14(spark, sf_dir):
    v = K.ramped_move(F.col("tvt"), F.col("tvt") + 40, F.col("row_idx"), F.col("n"), 0.64, 12.0)
    return wells(spark, sf_dir).select("well_id", "row_idx", R(v).alias("v"))


@query("p15_damping", f"WITH {WELLS} SELECT well_id, row_idx, round(0.7 * (tvt * (1 - 0.3 * (1 - exp(-md / 500)))) + 0.3 * z, 6) AS v FROM h")
def p15(spark, sf_dir):
    return wells(spark, sf_dir).select("well_id", "row_idx", R(0.7 * C.damp(F.col("tvt"), F.col("md"), 500.0, 0.3) + 0.3 * F.col("z")).alias("v"))


@query("p16_family_indicators", "SELECT o_orderkey, CAST(lower(regexp_replace(o_orderpriority, '^[0-9]-', '')) = 'urgent' AS INTEGER) AS is_urgent, CAST(lower(regexp_replace(o_orderpriority, '^[0-9]-', '')) = 'low' AS INTEGER) AS is_low FROM orders")
def p16(spark, sf_dir):
    f = F.lower(F.regexp_replace("o_orderpriority", "^[0-9]-", ""))
    return table(spark, sf_dir, "orders").select("o_orderkey", (f == "urgent").cast("int").alias("is_urgent"), (f == "low").cast("int").alias("is_low"))


@query("p17_variant_names", "SELECT p_partkey, p_size / 10.0 AS beam, CAST(p_partkey % 7 AS DOUBLE) AS scale, CAST(NULL AS DOUBLE) AS hold FROM part")
def p17(spark, sf_dir):
    n = F.concat(F.lit("pf_scale_"), (F.col("p_partkey") % 7).cast("string"), F.lit("_beam_"), (F.col("p_size") / 10.0).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", *[C.variant_part(n, x).alias(x) for x in ("beam", "scale", "hold")])


@query("p18_row_ids", f"WITH {WELLS} SELECT CAST(well_id AS VARCHAR) || '_' || CAST(row_idx AS VARCHAR) AS id, row_idx AS \"row\", CAST(well_id AS VARCHAR) AS well FROM h")
def p18(spark, sf_dir):
    h = wells(spark, sf_dir).select(C.row_id(F.col("well_id"), F.col("row_idx")).alias("id"))
    return h.select("id", C.row_of(F.col("id")).alias("row"), C.well_of(F.col("id")).alias("well"))


@query("p19_deployable_guard", f"WITH {SCORED} SELECT count(*) AS n FROM k WHERE family <> '1-URGENT'")
def p19(spark, sf_dir):
    from strataflow.operators.contracts import forbid, require

    s = forbid(scored(spark, sf_dir), {"truth", "target"}).where("family <> '1-URGENT'")
    return require(s, F.col("family") != "1-URGENT", "contact candidates may not be deployed").agg(F.count(F.lit(1)).alias("n"))


@query("x2_balanced_folds", f"WITH {WELLS}, s AS (SELECT well_id, count(*) AS n FROM h GROUP BY well_id), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, well_id) - 1 AS r FROM s) SELECT well_id, n, CAST(CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS INTEGER) AS fold FROM r")
def x2(spark, sf_dir):
    return X.balanced_folds(wells(spark, sf_dir), "well_id", 5)


@query("x1_stratified_folds", "WITH d AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('0:' || c_custkey), c_custkey) - 1 AS r FROM customer) SELECT c_custkey, c_mktsegment, CAST(r % 5 AS INTEGER) AS fold FROM d")
def x1(spark, sf_dir):
    return X.stratified_folds(table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment", 5)


@query("x3_fold_membership", "SELECT c_custkey % 5 AS fold, count(*) AS n FROM customer GROUP BY 1")
def x3(spark, sf_dir):
    return X.modulo_folds(table(spark, sf_dir, "customer"), "c_custkey", 5).groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count(F.lit(1)).alias("n"))


@query("x4_out_of_fold_means", """WITH c AS (SELECT c_custkey, c_custkey % 5 AS fold, c_mktsegment AS m, c_acctbal AS v FROM customer), l AS (SELECT m, fold, sum(v) AS s, count(*) AS n FROM c GROUP BY ALL),
o AS (SELECT m, fold, sum(s) OVER (PARTITION BY m) - s AS os, sum(n) OVER (PARTITION BY m) - n AS n FROM l) SELECT c_custkey, round(os / n, 8) AS oof_mean FROM c JOIN o USING (m, fold)""")
def x4(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("fold", F.col("c_custkey") % 5)
    return X.out_of_fold_means(c, "c_custkey", "fold", "c_mktsegment", "c_acctbal").select("c_custkey", R(F.col("oof_mean"), 8).alias("oof_mean"))


@query("x7_level_shape", f"WITH {PREDICTIONS} SELECT well, row, round(avg(pred) OVER (PARTITION BY well), 4) AS level, round(pred - avg(pred) OVER (PARTITION BY well), 4) + 0.0 AS shape FROM p")
def x7(spark, sf_dir):
    m = F.avg("pred").over(W.partitionBy("well"))
    return predictions(spark, sf_dir).select("well", "row", R(m, 4).alias("level"), R(F.col("pred") - m, 4).alias("shape"))


@query("x8_blend_sweep", f"WITH {PREDICTIONS}, m AS (SELECT avg((pred - y) * (pred - y)) AS aa, avg((pred - y) * (30000 - y)) AS ab, avg((30000 - y) * (30000 - y)) AS bb FROM p), s AS (SELECT unnest(range(0, 11))::INTEGER AS step) SELECT step, step / 10.0 AS weight, round(sqrt((step / 10.0) * (step / 10.0) * aa + 2 * (step / 10.0) * (1 - step / 10.0) * ab + (1 - step / 10.0) * (1 - step / 10.0) * bb), 3) AS rmse FROM m, s")
def x8(spark, sf_dir):
    t = X.blend_sweep(predictions(spark, sf_dir).withColumn("b", F.lit(30000.0)), "pred", "b", "y")
    return t.select("step", "weight", R(F.col("rmse"), 3).alias("rmse"))


@query("g7_soft_targets", f"""WITH {WELLS}, q AS (SELECT well_id, row_idx, tvt FROM h), l AS (SELECT CAST(x AS DOUBLE) AS lev FROM (SELECT unnest(range(60, 141)) AS x)),
d AS (SELECT q.*, lev, exp(-(lev - tvt) * (lev - tvt) / 8.0) AS e FROM q, l) SELECT well_id, row_idx, lev AS level, round(e / t, 8) AS p FROM (SELECT *, sum(e) OVER (PARTITION BY well_id, row_idx) AS t FROM d) WHERE abs(lev - tvt) <= 10""")
def g7(spark, sf_dir):
    from strataflow.operators.posterior import soft_targets

    t = soft_targets(wells(spark, sf_dir), "tvt", 60, 140, 1.0, 2.0, 10.0)
    return t.select("well_id", "row_idx", "level", R(F.col("p"), 8).alias("p"))
