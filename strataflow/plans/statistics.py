"""Queries of aggregations: errors, fits, calibration, binning, weighted and ranked statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataflow.functions import columns as C
from strataflow.operators import aggregates as A
from strataflow.operators import sequence as S
from strataflow.plans.proxies import CURVES, PREDICTIONS, WELLS, curves, predictions, wells
from strataflow.plans.registry import query
from strataflow.tables import table

R = lambda c, n=6: F.round(c, n)
G = "g AS (SELECT well, fold, count(*) AS n, sum((pred - y) * (pred - y)) AS sse, avg(pred - y) AS bias, sqrt(avg((pred - y) * (pred - y))) AS rmse FROM p GROUP BY well, fold)"


@query("a1_row_and_group_rmse", f"WITH {PREDICTIONS}, {G} SELECT round(sqrt(sum(sse) / sum(n)), 4) AS rmse, round(avg(rmse), 4) AS mean_per_group FROM g")
def a1(spark, sf_dir):
    return A.diagnose(predictions(spark, sf_dir)).select(R(F.col("rmse"), 4).alias("rmse"), R(F.col("mean_per_group"), 4).alias("mean_per_group"))


@query("a2_level_and_swing", f"""WITH {PREDICTIONS}, {G} SELECT round(sqrt(avg(bias * bias)), 4) AS level, round(sqrt(sum(sse - n * bias * bias) / sum(n)), 4) AS swing FROM g""")
def a2(spark, sf_dir):
    return A.diagnose(predictions(spark, sf_dir)).select(R(F.col("level"), 4).alias("level"), R(F.col("swing"), 4).alias("swing"))


@query("a3_rmse_quantiles", f"""WITH {PREDICTIONS}, {G}, q AS (SELECT quantile_cont(rmse, 0.05) AS q05, quantile_cont(rmse, 0.25) AS q25, quantile_cont(rmse, 0.5) AS q50, quantile_cont(rmse, 0.75) AS q75, quantile_cont(rmse, 0.95) AS q95, avg(rmse) AS mean FROM g)
SELECT round(q05, 4) AS q05, round(q25, 4) AS q25, round(q50, 4) AS q50, round(q75, 4) AS q75, round(q95, 4) AS q95, round(mean, 4) AS mean, (SELECT round(avg(rmse), 4) FROM g WHERE rmse <= q95) AS mean_below_q95 FROM q""")
def a3(spark, sf_dir):
    t = A.tail_quantiles(A.error_table(predictions(spark, sf_dir)), "rmse")
    return t.select(*[R(F.col(c), 4).alias(c) for c in t.columns])


DRAWS, DRAWN = 10_000, 150


@query(
    "a4_subsampled_rmse",
    f"""WITH {PREDICTIONS}, g AS (SELECT well, count(*) AS n, sum((pred - y) * (pred - y)) AS sse FROM p GROUP BY well),
k AS (SELECT *, row_number() OVER (ORDER BY well) - 1 AS place FROM g),
i AS (SELECT x // {DRAWN} AS draw, x % {DRAWN} AS j FROM (SELECT unnest(range({DRAWS * DRAWN})) AS x)),
d AS (SELECT DISTINCT draw, CAST(floor({C.hash_unit_sql('draw', 'j')} * (SELECT count(*) FROM g)) AS BIGINT) AS place FROM i),
r AS (SELECT draw, sqrt(sum(sse) / sum(n)) AS rmse FROM d JOIN k USING (place) GROUP BY draw)
SELECT round(avg(rmse), 4) AS mean, round(stddev_samp(rmse), 4) AS spread, count(*) AS draws FROM r""",
)
def a4(spark, sf_dir):
    g = A.error_table(predictions(spark, sf_dir))
    d = A.subsamples(g, "well", DRAWS, DRAWN).groupBy("draw").agg(F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"))
    return d.agg(R(F.avg("rmse"), 4).alias("mean"), R(F.stddev_samp("rmse"), 4).alias("spread"), F.count(F.lit(1)).alias("draws"))


@query("a5_pooled_rmse", f"WITH {PREDICTIONS}, {G} SELECT fold, round(sqrt(sum(sse) / sum(n)), 4) AS rmse FROM g GROUP BY fold")
def a5(spark, sf_dir):
    p = predictions(spark, sf_dir)
    g = p.groupBy("well", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("pred") - F.col("y")) * (F.col("pred") - F.col("y"))).alias("sse"))
    return g.groupBy("fold").agg(R(F.sqrt(F.sum("sse") / F.sum("n")), 4).alias("rmse"))


@query("a6_fold_table", f"WITH {PREDICTIONS} SELECT fold, count(*) AS n, round(sqrt(avg((pred - y) * (pred - y))), 4) AS rmse FROM p GROUP BY GROUPING SETS ((fold), ())")
def a6(spark, sf_dir):
    e = F.col("pred") - F.col("y")
    return predictions(spark, sf_dir).rollup("fold").agg(F.count(F.lit(1)).alias("n"), R(F.sqrt(F.avg(e * e)), 4).alias("rmse"))


def _slope(n):
    cut = f"WHERE r <= {n}" if n else ""
    @query(f"a7_slope_{n or 'all'}", f"""WITH {WELLS}, t AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY row_idx DESC) AS r FROM h WHERE tvt_input IS NOT NULL)
SELECT well_id, round(CASE WHEN count(*) >= 2 AND stddev_pop(md) >= 1e-6 THEN regr_slope(tvt_input, md) ELSE 0 END, 7) + 0.0 AS slope FROM t {cut} GROUP BY well_id""")
    def q(spark, sf_dir):
        h = wells(spark, sf_dir).where("tvt_input is not null")
        h = S.tail(h, n) if n else h
        return h.groupBy("well_id").agg(R(A.robust_slope("tvt_input", "md"), 7).alias("slope"))


_slope(0)
_slope(50)
_slope(20)

RATE = f"r0 AS (SELECT *, (tvt + z - lag(tvt + z) OVER w) / greatest(md - lag(md) OVER w, 1.0) AS r0, row_number() OVER (PARTITION BY well_id ORDER BY row_idx DESC) AS back FROM h WHERE tvt_input IS NOT NULL WINDOW w AS (PARTITION BY well_id ORDER BY row_idx)), r AS (SELECT *, round(r0, 6) + 0.0 AS rate FROM r0)"


def rates(spark, sf_dir):
    o = W.partitionBy("well_id").orderBy("row_idx")
    u = F.col("tvt") + F.col("z")
    h = wells(spark, sf_dir).where("tvt_input is not null").withColumn("u", u)
    rate = (F.col("u") - F.lag("u").over(o)) / F.greatest(F.col("md") - F.lag("md").over(o), F.lit(1.0))
    return h.withColumns({"rate": F.round(rate, 6), "back": F.row_number().over(W.partitionBy("well_id").orderBy(F.desc("row_idx")))})


@query("a8_tail_rate", f"WITH {WELLS}, {RATE} SELECT well_id, CASE WHEN count(rate) >= 3 THEN round(median(rate), 7) + 0.0 END AS rate FROM r WHERE back <= 30 GROUP BY well_id")
def a8(spark, sf_dir):
    r = rates(spark, sf_dir).where("back <= 30").groupBy("well_id")
    return r.agg(F.when(F.count("rate") >= 3, R(F.median("rate"), 7)).alias("rate"))


@query("a9_trimmed_rate", f"""WITH {WELLS}, {RATE}, q AS (SELECT well_id, quantile_cont(rate, 0.05) AS lo, quantile_cont(rate, 0.95) AS hi FROM r GROUP BY well_id)
SELECT well_id, round(median(rate), 6) + 0.0 AS trimmed_median FROM r JOIN q USING (well_id) WHERE rate BETWEEN lo AND hi GROUP BY well_id""")
def a9(spark, sf_dir):
    return A.trimmed_median(rates(spark, sf_dir), "well_id", "rate").select("well_id", R(F.col("trimmed_median")).alias("trimmed_median"))


@query("a10_plane_fit", f"""WITH {WELLS}, m AS (SELECT count(*)::DOUBLE AS s0, sum(x) AS su, sum(y) AS sv, sum(x*x) AS suu, sum(x*y) AS suv, sum(y*y) AS svv, sum(tvt) AS sz, sum(x*tvt) AS suz, sum(y*tvt) AS svz FROM h),
d AS (SELECT *, s0 * (suu * svv - suv * suv) - su * (su * svv - suv * sv) + sv * (su * suv - suu * sv) AS det FROM m)
SELECT round((s0 * (suz * svv - suv * svz) - sz * (su * svv - suv * sv) + sv * (su * svz - suz * sv)) / det, 7) AS slope_x FROM d""")
def a10(spark, sf_dir):
    from strataflow.operators.spatial import cramer3

    x, y, z = F.col("x"), F.col("y"), F.col("tvt")
    m = wells(spark, sf_dir).agg(F.count(F.lit(1)).cast("double").alias("s0"), F.sum(x).alias("su"), F.sum(y).alias("sv"), F.sum(x * x).alias("suu"), F.sum(x * y).alias("suv"), F.sum(y * y).alias("svv"), F.sum(z).alias("sz"), F.sum(x * z).alias("suz"), F.sum(y * z).alias("svz"))
    return m.select(R(cramer3()[1], 7).alias("slope_x"))


PAIRS = f"{WELLS}, {CURVES}, j AS (SELECT h.well_id, h.gr AS obs, c.gr / 20.0 AS ex FROM h JOIN c ON c.curve_id = h.curve_id AND c.tvt = round(h.tvt) WHERE h.gr IS NOT NULL)"


def pairs(spark, sf_dir):
    h = wells(spark, sf_dir).where("gr is not null").withColumn("at", F.round("tvt")).withColumnRenamed("gr", "obs")
    c = curves(spark, sf_dir).select("curve_id", F.col("tvt").alias("at"), (F.col("gr") / 20.0).alias("ex"))
    return h.join(c, ["curve_id", "at"]).select("well_id", "obs", "ex")


@query("a11_affine", f"""WITH {PAIRS} SELECT well_id, count(*) AS n_pairs, CASE WHEN count(*) >= 20 AND stddev_pop(obs) > 1e-6 THEN round(regr_slope(ex, obs), 6) + 0.0 ELSE 1 END AS gain,
 CASE WHEN count(*) >= 20 AND stddev_pop(obs) > 1e-6 THEN round(regr_intercept(ex, obs), 5) ELSE 0 END AS "offset" FROM j GROUP BY well_id""")
def a11(spark, sf_dir):
    return A.affine(pairs(spark, sf_dir), "well_id", "obs", "ex").select("well_id", "n_pairs", R(F.col("gain")).alias("gain"), R(F.col("offset"), 5).alias("offset"))


@query("a11_affine_robust", f"""WITH {PAIRS}, f AS (SELECT well_id, count(*) AS n, regr_slope(ex, obs) AS a, regr_intercept(ex, obs) AS b, stddev_pop(obs) AS s FROM j GROUP BY well_id),
r AS (SELECT j.*, ex - CASE WHEN n >= 20 AND s > 1e-6 THEN a ELSE 1 END * obs - CASE WHEN n >= 20 AND s > 1e-6 THEN b ELSE 0 END AS r FROM j JOIN f USING (well_id)),
m AS (SELECT well_id, median(r) AS m FROM r GROUP BY well_id), d AS (SELECT r.*, abs(r - m) AS d FROM r JOIN m USING (well_id)), md AS (SELECT well_id, median(d) * 1.4826 AS mad FROM d GROUP BY well_id),
k AS (SELECT d.* FROM d JOIN md USING (well_id) WHERE d <= 3.0 * greatest(mad, 1e-6))
SELECT well_id, count(*) AS n_pairs, round(greatest(0.2, least(5.0, CASE WHEN count(*) >= 20 AND stddev_pop(obs) > 1e-6 THEN regr_slope(ex, obs) ELSE 1 END)), 6) AS gain FROM k GROUP BY well_id""")
def a11_robust(spark, sf_dir):
    return A.affine_robust(pairs(spark, sf_dir), "well_id", "obs", "ex").select("well_id", "n_pairs", R(F.col("gain")).alias("gain"))


@query("a11_affine_shrunk", f"""WITH {PAIRS}, f AS (SELECT well_id, CASE WHEN count(*) >= 20 AND stddev_pop(obs) > 1e-6 THEN regr_slope(ex, obs) ELSE 1 END AS a, CASE WHEN count(*) >= 20 AND stddev_pop(obs) > 1e-6 THEN regr_intercept(ex, obs) ELSE 0 END AS b FROM j GROUP BY well_id)
SELECT well_id, round(1 + (a - 1) * 0.5, 6) AS gain, round(b * 0.5, 5) AS "offset" FROM f""")
def a11_shrunk(spark, sf_dir):
    g, o = A.shrunk(F.col("gain"), F.col("offset"))
    return A.affine(pairs(spark, sf_dir), "well_id", "obs", "ex").select("well_id", R(g).alias("gain"), R(o, 5).alias("offset"))


@query("a11_noise_scale", f"""WITH {PAIRS} SELECT well_id, round(CASE WHEN count(*) >= 20 THEN greatest(10, least(60, stddev_pop(obs - ex))) ELSE 30 END, 5) AS sigma FROM j GROUP BY well_id""")
def a11_noise(spark, sf_dir):
    return A.noise_scale(pairs(spark, sf_dir).withColumn("r", F.col("obs") - F.col("ex")), "well_id", "r").select("well_id", R(F.col("sigma"), 5).alias("sigma"))


@query("a12_bias_terms", f"""WITH {WELLS}, k AS (SELECT well_id, row_idx, tvt_input + z - (x * 0.1) AS b, row_number() OVER (PARTITION BY well_id ORDER BY row_idx) - 1 AS i, row_number() OVER (PARTITION BY well_id ORDER BY row_idx DESC) AS back,
 count(*) OVER (PARTITION BY well_id) AS n FROM h WHERE tvt_input IS NOT NULL)
SELECT well_id, round(median(b), 5) AS bias_all, round(median(b) FILTER (WHERE back <= 50), 5) AS bias_tail, round(sum(exp(0.02 * (i - n)) * b) / sum(exp(0.02 * (i - n))), 5) AS bias_weighted FROM k GROUP BY well_id""")
def a12(spark, sf_dir):
    h = wells(spark, sf_dir).where("tvt_input is not null").withColumn("b", F.col("tvt_input") + F.col("z") - F.col("x") * 0.1)
    t = A.bias_terms(h, "well_id", "row_idx", "b")
    return t.select("well_id", *[R(F.col(c), 5).alias(c) for c in t.columns[1:]])


@query("a13_correlations", f"""WITH {WELLS}, k AS (SELECT well_id, gr AS a, z AS b FROM h WHERE gr IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY well_id ORDER BY a) + (count(*) OVER (PARTITION BY well_id, a) - 1) / 2.0 AS ra,
 rank() OVER (PARTITION BY well_id ORDER BY b) + (count(*) OVER (PARTITION BY well_id, b) - 1) / 2.0 AS rb FROM k)
SELECT well_id, round(CASE WHEN stddev_pop(a) > 1e-9 AND stddev_pop(b) > 1e-9 THEN corr(a, b) ELSE 0 END, 6) AS pearson, round(CASE WHEN stddev_pop(ra) > 1e-9 AND stddev_pop(rb) > 1e-9 THEN corr(ra, rb) ELSE 0 END, 6) AS spearman FROM r GROUP BY well_id""")
def a13(spark, sf_dir):
    t = A.correlations(wells(spark, sf_dir), "well_id", "gr", "z")
    return t.select("well_id", R(F.col("pearson")).alias("pearson"), R(F.col("spearman")).alias("spearman"))


@query("a14_huber_score", f"WITH {PREDICTIONS} SELECT well, round(avg(CASE WHEN abs(pred - y) / 5000 <= 1 THEN pow(abs(pred - y) / 5000, 2) / 2 ELSE abs(pred - y) / 5000 - 0.5 END), 6) AS score FROM p GROUP BY well")
def a14(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("well").agg(R(F.avg(A.huber(F.col("pred") - F.col("y"), 5000.0))).alias("score"))


WQ = "v AS (SELECT o_custkey AS k, o_totalprice AS v, CAST(o_orderkey % 7 + 1 AS DOUBLE) AS w FROM orders), r AS (SELECT *, sum(w) OVER (PARTITION BY k ORDER BY v, w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, sum(w) OVER (PARTITION BY k) AS al FROM v)"


def weighted(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), (F.col("o_orderkey") % 7 + 1).cast("double").alias("w"))


@query("a15_weighted_quantile", f"WITH {WQ} SELECT k, min(v) AS weighted_quantile FROM r WHERE run >= 0.4 * al GROUP BY k")
def a15(spark, sf_dir):
    return A.weighted_quantile(weighted(spark, sf_dir), "k", "v", "w", 0.4)


@query("a15_trimmed_weighted_mean", f"WITH {WQ} SELECT k, round(sum(w * v) / sum(w), 7) AS trimmed_mean FROM r WHERE run / al BETWEEN 0.1 AND 0.9 GROUP BY k")
def a15_trim(spark, sf_dir):
    return A.trimmed_weighted_mean(weighted(spark, sf_dir), "k", "v", "w", 0.1, 0.9).select("k", R(F.col("trimmed_mean"), 7).alias("trimmed_mean"))


@query("a16_bins", f"""WITH {WELLS} SELECT well_id, row_idx // 8 AS bin, round(avg(gr), 6) AS mean, round(stddev_pop(gr), 5) AS std, count(gr) AS n, round(count(gr) / 8.0, 6) AS rate, min(gr) AS low, max(gr) AS high,
 round(arg_max(gr, row_idx) FILTER (WHERE gr IS NOT NULL) - arg_min(gr, row_idx) FILTER (WHERE gr IS NOT NULL), 6) + 0.0 AS change, CASE WHEN count(gr) >= 2 THEN round(regr_slope(gr, CASE WHEN gr IS NOT NULL THEN md END), 8) + 0.0 END AS slope FROM h GROUP BY ALL""")
def a16(spark, sf_dir):
    b = A.bins(wells(spark, sf_dir), 8)
    return b.select("well_id", "bin", R(F.col("mean")).alias("mean"), R(F.col("std"), 5).alias("std"), "n", R(F.col("rate")).alias("rate"), "low", "high", R(F.col("change")).alias("change"), R(F.col("slope"), 8).alias("slope"))


@query("a17_quadratic", f"""WITH {WELLS}, k AS (SELECT well_id, row_idx // 16 AS bin, CAST(row_idx % 16 AS DOUBLE) AS t, gr AS v FROM h WHERE gr IS NOT NULL),
m AS (SELECT well_id, bin, count(*)::DOUBLE AS n, sum(t) AS s1, sum(t*t) AS s2, sum(t*t*t) AS s3, sum(t*t*t*t) AS s4, sum(v) AS z0, sum(t*v) AS z1, sum(t*t*v) AS z2 FROM k GROUP BY ALL HAVING count(*) >= 6),
d AS (SELECT *, n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS det FROM m)
SELECT well_id, bin, round((n * (s2 * z2 - z1 * s3) - s1 * (s1 * z2 - z1 * s2) + z0 * (s1 * s3 - s2 * s2)) / det, 5) + 0.0 AS c FROM d""")
def a17(spark, sf_dir):
    h = wells(spark, sf_dir).where("gr is not null").withColumns({"bin": F.floor(F.col("row_idx") / 16).cast("long"), "t": (F.col("row_idx") % 16).cast("double")})
    full = h.groupBy("well_id", "bin").agg(F.count(F.lit(1)).alias("c")).where("c >= 6").drop("c")
    return A.quadratic(h.join(full, ["well_id", "bin"]), ["well_id", "bin"], "gr", "t").select("well_id", "bin", R(F.col("c"), 5).alias("c"))


@query("a18_split_bins", f"""WITH {WELLS}, f AS (SELECT well_id, min(CASE WHEN tvt_input IS NULL THEN row_idx END) AS f FROM h GROUP BY well_id)
SELECT h.well_id, CAST(floor((row_idx - f) / 8.0) AS BIGINT) AS bin, round(avg(gr), 6) AS mean FROM h JOIN f USING (well_id) GROUP BY ALL""")
def a18(spark, sf_dir):
    h = wells(spark, sf_dir)
    f = S.first_hidden(h).select("well_id", "first_hidden")
    b = F.floor((F.col("row_idx") - F.col("first_hidden")) / 8.0).cast("long").alias("bin")
    return h.join(f, "well_id").groupBy("well_id", b).agg(R(F.avg("gr")).alias("mean"))


@query("a19_duplicate_key_mean", "SELECT l_suppkey, l_quantity AS q, round(avg(l_extendedprice), 7) AS v FROM lineitem GROUP BY ALL")
def a19(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.bround("l_quantity", 3).alias("q")).agg(R(F.avg("l_extendedprice"), 7).alias("v"))


@query("a20_repeat_average", """SELECT c_custkey % 100 AS k, round(avg(c_acctbal), 7) AS pred, count(*) AS repeats FROM customer GROUP BY 1""")
def a20(spark, sf_dir):
    from strataflow.operators.contracts import require

    g = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 100).alias("k")).agg(R(F.avg("c_acctbal"), 7).alias("pred"), F.count(F.lit(1)).alias("repeats"))
    return require(g, F.col("repeats") >= 1, "a repeat is missing")


@query("a21_centroids", f"WITH {WELLS} SELECT well_id, round(avg(x), 8) AS x, round(avg(y), 8) AS y FROM h GROUP BY well_id")
def a21(spark, sf_dir):
    from strataflow.operators.spatial import centroids

    return centroids(wells(spark, sf_dir)).select("well_id", R(F.col("x"), 8).alias("x"), R(F.col("y"), 8).alias("y"))


@query("a23_weighted_stats", "WITH v AS (SELECT o_custkey AS k, o_totalprice / 1000 AS v, CAST(o_orderkey % 7 + 1 AS DOUBLE) AS w FROM orders) SELECT k, round(sum(w*v)/sum(w), 9) AS w_mean, round(sqrt(greatest(sum(w*v*v)/sum(w) - pow(sum(w*v)/sum(w), 2), 0)), 3) AS w_std, round(sum(w*abs(v))/sum(w), 9) AS w_abs FROM v GROUP BY k")
def a23(spark, sf_dir):
    t = A.weighted_stats(weighted(spark, sf_dir).withColumn("v", F.col("v") / 1000), "k", "v", "w")
    return t.select("k", R(F.col("w_mean"), 9).alias("w_mean"), R(F.col("w_std"), 3).alias("w_std"), R(F.col("w_abs"), 9).alias("w_abs"))


@query("a23_log_sum_exp", "SELECT o_custkey AS k, round(max(o_totalprice / 1000) + 5 * ln(sum(exp((o_totalprice / 1000 - m) / 5))), 5) AS lse FROM (SELECT *, max(o_totalprice / 1000) OVER (PARTITION BY o_custkey) AS m FROM orders) GROUP BY 1")
def a23_lse(spark, sf_dir):
    return A.log_sum_exp(weighted(spark, sf_dir).withColumn("v", F.col("v") / 1000), "k", "v", 5.0).select("k", R(F.col("log_sum_exp"), 5).alias("lse"))


@query("a24_deciles", "WITH d AS (SELECT *, ntile(10) OVER (ORDER BY c_acctbal, c_custkey) AS decile FROM customer) SELECT CAST(decile AS INTEGER) AS decile, count(*) AS n, round(avg(c_acctbal), 7) AS mean_score, round(avg(CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM d GROUP BY decile")
def a24(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("s"), F.when(F.col("c_custkey") % 3 == 0, 1.0).otherwise(0.0).alias("y"))
    return A.deciles(c, "s", "y").select("decile", "n", R(F.col("mean_score"), 7).alias("mean_score"), R(F.col("rate")).alias("rate"))


@query("a25_auc", """WITH c AS (SELECT l_quantity AS s, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS y FROM lineitem), t AS (SELECT s, sum(y) AS p, count(*) AS n FROM c GROUP BY s),
o AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM t WINDOW w AS (ORDER BY s DESC))
SELECT round(sum((n - p) * (tp - p / 2.0)) / (sum(p) * sum(n - p)), 6) AS auc, round(sum(p * tp / seen) / sum(p), 6) AS average_precision FROM o""")
def a25(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("s"), F.when(F.col("l_discount") > 0.05, 1).otherwise(0).alias("y"))
    return A.auc(li, "y", "s").select(R(F.col("auc")).alias("auc"), R(F.col("average_precision")).alias("average_precision"))


@query("a26_importance_share", "SELECT p_type AS feature, round(sum(p_retailprice) / (SELECT sum(p_retailprice) FROM part), 8) AS share FROM part GROUP BY p_type")
def a26(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("feature")).agg(F.sum("p_retailprice").alias("s"))
    return g.select("feature", R(F.col("s") / F.sum("s").over(W.partitionBy()), 8).alias("share"))


@query("p8_standardise", "WITH s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS d FROM customer) SELECT c_custkey, round((c_acctbal - m) / d, 6) AS v FROM customer, s")
def p8(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    s = c.agg(F.avg("c_acctbal").alias("m"), F.stddev_pop("c_acctbal").alias("d"))
    return c.crossJoin(F.broadcast(s)).select("c_custkey", R(C.standardise(F.col("c_acctbal"), F.col("m"), F.col("d"))).alias("v"))


@query("p9_power_compression", f"WITH {WELLS}, k AS (SELECT well_id, row_idx, pow(value_pos, 0.5) AS p, value_pos AS v FROM (SELECT well_id, row_idx, gr AS value_pos FROM h WHERE gr > 0)) SELECT well_id, row_idx, round(p * avg(v) OVER (PARTITION BY well_id) / avg(p) OVER (PARTITION BY well_id), 5) AS v FROM k")
def p9(spark, sf_dir):
    w = W.partitionBy("well_id")
    h = wells(spark, sf_dir).where("gr > 0").withColumn("p", F.pow("gr", F.lit(0.5)))
    return h.select("well_id", "row_idx", R(F.col("p") * F.avg("gr").over(w) / F.avg("p").over(w), 5).alias("v"))
