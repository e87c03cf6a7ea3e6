"""Queries of the ordered-series operators, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.operators import sequence as S
from strataflow.plans.proxies import WELLS, wells
from strataflow.plans.registry import query

R = lambda c, n=6: F.round(c, n)
RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
O = "PARTITION BY well_id ORDER BY row_idx"  # noqa: E741


def sql(body: str) -> str:
    return f"WITH {WELLS}\n{body}"


@query("baseline_linear_forecast", sql(f"""
, k AS (SELECT *, count(tvt_input) OVER (PARTITION BY well_id) AS nk, count(*) OVER (PARTITION BY well_id) AS na FROM h),
s AS (SELECT well_id, arg_max(tvt_input, row_idx) FILTER (WHERE tvt_input IS NOT NULL) AS lt, arg_max(md, row_idx) FILTER (WHERE tvt_input IS NOT NULL) AS lm,
  CASE WHEN count(tvt_input) >= 2 AND stddev_pop(md) FILTER (WHERE tvt_input IS NOT NULL) >= 1e-6 THEN regr_slope(tvt_input, CASE WHEN tvt_input IS NOT NULL THEN md END) ELSE 0 END AS sl
  FROM k WHERE nk >= 10 AND nk < na GROUP BY well_id),
f AS (SELECT k.well_id, lt + sl * (md - lm) - tvt AS err FROM k JOIN s USING (well_id) WHERE tvt_input IS NULL),
g AS (SELECT well_id, count(*) AS n, sum(err * err) AS sse, avg(err) AS bias, sqrt(avg(err * err)) AS rmse FROM f GROUP BY well_id)
SELECT well_id, n, round(rmse, 6) AS rmse, round(bias, 6) AS bias, round(sqrt(greatest(sse - n * bias * bias, 0) / n), 6) AS swing FROM g"""))  # fmt: skip
def baseline_linear_forecast(spark, sf_dir):
    """Known rows, their slope, its extrapolation over the hidden rows, and the error by well."""
    from strataflow.operators.aggregates import robust_slope

    h = S.known_counts(wells(spark, sf_dir))
    known = F.col("tvt_input").isNotNull()
    at = F.when(known, F.col("row_idx"))
    fit = h.groupBy("well_id").agg(F.max_by("tvt_input", at).alias("lt"), F.max_by("md", at).alias("lm"), robust_slope("tvt_input", "md", known).alias("sl"))
    e = h.where(~known).join(fit, "well_id").withColumn("err", F.col("lt") + F.col("sl") * (F.col("md") - F.col("lm")) - F.col("tvt"))
    g = e.groupBy("well_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("err") * F.col("err")).alias("sse"), F.avg("err").alias("b"))
    swing = F.sqrt(F.greatest(F.col("sse") - F.col("n") * F.col("b") * F.col("b"), F.lit(0.0)) / F.col("n"))
    return g.select("well_id", "n", R(F.sqrt(F.col("sse") / F.col("n"))).alias("rmse"), R(F.col("b")).alias("bias"), R(swing).alias("swing"))


@query("p1_known_hidden_split", sql("""SELECT well_id, count(tvt_input) AS n_known, count(*) - count(tvt_input) AS n_hidden FROM h GROUP BY well_id
 HAVING count(tvt_input) >= 10 AND count(*) > count(tvt_input)"""))
def p1(spark, sf_dir):
    return S.known_counts(wells(spark, sf_dir)).select("well_id", "n_known", "n_hidden").distinct()


@query("p2_anchor", sql("""SELECT well_id, arg_max(tvt_input, row_idx) AS last_tvt_input, arg_max(z, row_idx) AS last_z, arg_max(md, row_idx) AS last_md
 FROM h WHERE tvt_input IS NOT NULL GROUP BY well_id"""))
def p2(spark, sf_dir):
    return S.anchors(wells(spark, sf_dir)).where("tvt_input is not null").select("well_id", "last_tvt_input", "last_z", "last_md").distinct()


@query("p3_relative_geometry", sql(f"""
, a AS (SELECT well_id, arg_max(x, row_idx) AS lx, arg_max(y, row_idx) AS ly, arg_max(z, row_idx) AS lz, arg_max(md, row_idx) AS lm FROM h WHERE tvt_input IS NOT NULL GROUP BY well_id)
SELECT h.well_id, row_idx, md - lm AS md_since, round(z - lz, 6) AS dz, round(sqrt((x - lx) * (x - lx) + (y - ly) * (y - ly)), 6) AS dxy,
 round((row_number() OVER ({O.replace('well_id', 'h.well_id')}) - 1) / greatest(count(*) OVER (PARTITION BY h.well_id) - 1, 1), 6) AS frac
 FROM h JOIN a ON a.well_id = h.well_id WHERE tvt_input IS NULL"""))
def p3(spark, sf_dir):
    g = S.relative_geometry(wells(spark, sf_dir)).where("last_md is not null")
    return g.select("well_id", "row_idx", "md_since", R(F.col("dz")).alias("dz"), R(F.col("dxy")).alias("dxy"), R(F.col("frac")).alias("frac"))


@query("p5_drift_and_level", sql("""SELECT well_id, row_idx, round(tvt - l, 6) AS drift, round((tvt - l) + l, 6) AS level
 FROM (SELECT *, arg_max(tvt_input, row_idx) FILTER (WHERE tvt_input IS NOT NULL) OVER (PARTITION BY well_id) AS l FROM h) WHERE l IS NOT NULL"""))
def p5(spark, sf_dir):
    a = S.anchors(wells(spark, sf_dir), "tvt_input").where("last_tvt_input is not null").withColumn("d", F.col("tvt") - F.col("last_tvt_input"))
    return a.select("well_id", "row_idx", R(F.col("d")).alias("drift"), R(F.col("d") + F.col("last_tvt_input")).alias("level"))


@query("p6_sanitise", """SELECT event_id, CASE WHEN event_id % 10 IN (0, 1) THEN NULL ELSE value END AS value FROM events""")
def p6(spark, sf_dir):
    from strataflow.functions.columns import finite
    from strataflow.tables import table

    e = table(spark, sf_dir, "events")
    dirty = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).when(F.col("event_id") % 10 == 1, F.lit(float("-inf"))).otherwise(F.col("value"))
    return e.select("event_id", finite(dirty).alias("value"))


def _rolled(width, kind, fn):
    @query(f"w1_rolling_{kind}_{width}", sql(f"SELECT well_id, row_idx, round({fn}(gr) OVER (PARTITION BY well_id ORDER BY row_idx ROWS BETWEEN {width // 2} PRECEDING AND {width // 2} FOLLOWING), 6) AS v FROM h"))
    def q(spark, sf_dir):
        return wells(spark, sf_dir).select("well_id", "row_idx", R(S.rolling("gr", width, kind)).alias("v"))


_rolled(5, "mean", "avg")
_rolled(9, "max", "max")
_rolled(15, "std", "stddev_samp")
_rolled(11, "median", "median")


@query("w2_differences", sql(f"""SELECT well_id, row_idx, round(coalesce(z - lag(z) OVER w, 0), 6) + 0.0 AS d1,
 round(coalesce(z - lag(z) OVER w - coalesce(lag(z) OVER w - lag(z, 2) OVER w, 0), 0), 6) + 0.0 AS d2 FROM h WINDOW w AS ({O})"""))
def w2(spark, sf_dir):
    return wells(spark, sf_dir).select("well_id", "row_idx", R(S.difference("z")).alias("d1"), R(S.difference("z", 2)).alias("d2"))


@query("w3_gradient", sql(f"""SELECT well_id, row_idx, round(CASE WHEN lag(z) OVER w IS NULL THEN lead(z) OVER w - z WHEN lead(z) OVER w IS NULL THEN z - lag(z) OVER w
 ELSE (lead(z) OVER w - lag(z) OVER w) / 2.0 END, 6) AS g FROM h WINDOW w AS ({O})"""))
def w3(spark, sf_dir):
    return wells(spark, sf_dir).select("well_id", "row_idx", R(S.gradient("z")).alias("g"))


@query("w3_gradient_in_runs", sql(f"""
, r AS (SELECT *, CASE WHEN gr IS NOT NULL THEN sum(CASE WHEN gr IS NULL THEN 1 ELSE 0 END) OVER ({O} {RUN}) END AS run FROM h)
SELECT well_id, row_idx, round(CASE WHEN gr IS NULL THEN NULL WHEN lag(gr) OVER w IS NULL THEN lead(gr) OVER w - gr WHEN lead(gr) OVER w IS NULL THEN gr - lag(gr) OVER w
 ELSE (lead(gr) OVER w - lag(gr) OVER w) / 2.0 END, 6) AS g FROM r WINDOW w AS (PARTITION BY well_id, run ORDER BY row_idx)"""))
def w3_runs(spark, sf_dir):
    return S.gradient_in_runs(wells(spark, sf_dir), "gr").select("well_id", "row_idx", R(F.col("gradient_gr")).alias("g"))


@query("w4_fill_linear", sql(f"""
, f AS (SELECT *, last_value(CASE WHEN gr IS NOT NULL THEN row_idx END IGNORE NULLS) OVER ({O} {RUN}) AS bt, last_value(gr IGNORE NULLS) OVER ({O} {RUN}) AS bv,
 first_value(CASE WHEN gr IS NOT NULL THEN row_idx END IGNORE NULLS) OVER ({O} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ft,
 first_value(gr IGNORE NULLS) OVER ({O} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS av FROM h)
SELECT well_id, row_idx, round(coalesce(CASE WHEN gr IS NOT NULL THEN gr WHEN bt IS NULL THEN av WHEN ft IS NULL THEN bv ELSE bv + (av - bv) * (row_idx - bt) / (ft - bt) END, 85.0), 6) AS gr FROM f"""))
def w4(spark, sf_dir):
    return wells(spark, sf_dir).select("well_id", "row_idx", R(S.fill_linear("gr", fallback=F.lit(85.0))).alias("gr"))


@query("w5_cumulative", sql(f"SELECT well_id, row_idx, round(sum(z * 0.5 + x * 0.25) OVER ({O} {RUN}), 4) AS c FROM h"))
def w5(spark, sf_dir):
    return wells(spark, sf_dir).select("well_id", "row_idx", R(F.sum(F.col("z") * 0.5 + F.col("x") * 0.25).over(S.so_far()), 4).alias("c"))


@query("w6_tortuosity", sql(f"""
, s AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w)), 0) AS st FROM h WINDOW w AS ({O})),
p AS (SELECT *, sum(st) OVER ({O} {RUN}) AS pa FROM s),
b AS (SELECT *, coalesce(lag(pa, 20) OVER w, first_value(pa) OVER w) AS pb, coalesce(lag(x, 20) OVER w, first_value(x) OVER w) AS xb, coalesce(lag(y, 20) OVER w, first_value(y) OVER w) AS yb,
 coalesce(lag(z, 20) OVER w, first_value(z) OVER w) AS zb FROM p WINDOW w AS ({O})),
c AS (SELECT *, sqrt((x - xb) * (x - xb) + (y - yb) * (y - yb) + (z - zb) * (z - zb)) AS ch FROM b)
SELECT well_id, row_idx, round(CASE WHEN ch > 1e-9 THEN (pa - pb) / ch ELSE 1.0 END, 5) AS tortuosity FROM c"""))
def w6(spark, sf_dir):
    return S.tortuosity(wells(spark, sf_dir), 20).select("well_id", "row_idx", R(F.col("tortuosity"), 5).alias("tortuosity"))


AZ = f"atan2(y - coalesce(lag(y, 5) OVER ({O}), first_value(y) OVER ({O})), x - coalesce(lag(x, 5) OVER ({O}), first_value(x) OVER ({O})))"


@query("w7_azimuth", sql(f"SELECT well_id, row_idx, round(sin({AZ}), 6) AS az_sin, round(cos({AZ}), 6) AS az_cos FROM h"))
def w7(spark, sf_dir):
    a = wells(spark, sf_dir).withColumn("a", S.azimuth(5))
    return a.select("well_id", "row_idx", R(F.sin("a")).alias("az_sin"), R(F.cos("a")).alias("az_cos"))


@query("w8_unwrap", sql(f"""
, a AS (SELECT well_id, row_idx, {AZ} AS a FROM h), d AS (SELECT *, a - lag(a) OVER ({O}) AS d FROM a)
SELECT well_id, row_idx, round(a + coalesce(sum(CASE WHEN d > pi() THEN -1 WHEN d < -pi() THEN 1 ELSE 0 END) OVER ({O} {RUN}), 0) * 2 * pi(), 5) AS a FROM d"""))
def w8(spark, sf_dir):
    a = S.unwrap(wells(spark, sf_dir).withColumn("a", S.azimuth(5, S.c_atan2)), "a")
    return a.select("well_id", "row_idx", R(F.col("unwrapped_a"), 5).alias("a"))


@query("w9_tail_rows", sql("SELECT well_id, row_idx, tvt_input FROM (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY row_idx DESC) AS r FROM h WHERE tvt_input IS NOT NULL) WHERE r <= 20"))
def w9(spark, sf_dir):
    return S.tail(wells(spark, sf_dir), 20, F.col("tvt_input").isNotNull()).select("well_id", "row_idx", "tvt_input")


@query("w23_run_violations", sql(f"""
, c AS (SELECT *, CAST(floor(tvt / 2) AS BIGINT) AS code FROM h), l AS (SELECT *, lag(code) OVER ({O}) AS b FROM c)
SELECT well_id, round(coalesce(sum(CASE WHEN code < b THEN 1 ELSE 0 END), 0) / greatest(count(*) - 1, 1), 6) AS step_down,
 round((sum(CASE WHEN b IS NULL OR b <> code THEN 1 ELSE 0 END) - count(DISTINCT code)) / count(*), 6) AS revisits FROM l GROUP BY well_id"""))
def w23(spark, sf_dir):
    v = S.run_violations(wells(spark, sf_dir).withColumn("code", F.floor(F.col("tvt") / 2)), "code")
    return v.select("well_id", R(F.coalesce("step_down", F.lit(0.0))).alias("step_down"), R(F.col("revisits")).alias("revisits"))


@query("w25_first_hidden", sql("""SELECT well_id, min(CASE WHEN tvt_input IS NULL THEN row_idx END) AS first_hidden, count(*) - count(tvt_input) AS n_hidden,
 coalesce(max(CASE WHEN tvt_input IS NOT NULL THEN row_idx END), -1) < coalesce(min(CASE WHEN tvt_input IS NULL THEN row_idx END), 1152921504606846976) AS is_suffix FROM h GROUP BY well_id"""))
def w25(spark, sf_dir):
    return S.first_hidden(wells(spark, sf_dir))
