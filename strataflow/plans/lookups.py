"""Queries of curve lookups and spatial neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.functions import columns as C
from strataflow.operators import lookup as L
from strataflow.operators import spatial as P
from strataflow.plans.proxies import CURVES, POINTS, WELLS, curves, points, wells
from strataflow.plans.registry import query
from strataflow.tables import table

R = lambda c, n=6: F.round(c, n)
SEG = "s AS (SELECT curve_id, tvt AS t0, gr AS g0, lead(tvt) OVER (PARTITION BY curve_id ORDER BY tvt) AS t1, lead(gr) OVER (PARTITION BY curve_id ORDER BY tvt) AS g1 FROM c)"
ENDS = "b AS (SELECT curve_id, min(tvt) AS lo, max(tvt) AS hi, arg_min(gr, tvt) AS glo, arg_max(gr, tvt) AS ghi FROM c GROUP BY curve_id)"
Q = "q AS (SELECT well_id, row_idx, curve_id, tvt, gr FROM h)"


def queries_of(spark, sf_dir):
    return wells(spark, sf_dir).select("well_id", "row_idx", "curve_id", F.col("tvt").alias("at"), F.col("gr").alias("obs"))


def lookup_sql(outside: str, at: str = "tvt") -> str:
    return f"""WITH {WELLS}, {CURVES}, {SEG}, {ENDS}, {Q}
SELECT well_id, row_idx, round(CASE WHEN q.{at} < lo THEN {outside.format('glo')} WHEN q.{at} > hi THEN {outside.format('ghi')} WHEN q.{at} = hi THEN ghi
 ELSE g0 + (g1 - g0) * (q.{at} - t0) / (t1 - t0) END, 6) AS v
FROM q JOIN b USING (curve_id) LEFT JOIN s ON s.curve_id = q.curve_id AND q.{at} >= t0 AND q.{at} < t1"""


@query("j3_interpolate_clamped", lookup_sql("{}"))
def j3(spark, sf_dir):
    return L.interpolate(queries_of(spark, sf_dir), curves(spark, sf_dir), "curve_id", "at", salts=2).select("well_id", "row_idx", R(F.col("looked_up")).alias("v"))


@query("j3_interpolate_inside_only", lookup_sql("CAST(NULL AS DOUBLE)"))
def j3_null(spark, sf_dir):
    q = L.interpolate(queries_of(spark, sf_dir), curves(spark, sf_dir), "curve_id", "at", clamp=False)
    return q.select("well_id", "row_idx", R(F.col("looked_up")).alias("v"))


@query("j3b_nearest_place", f"""WITH {WELLS}, {CURVES}, {Q},
n AS (SELECT q.well_id, q.row_idx, c.tvt, c.gr, row_number() OVER (PARTITION BY q.well_id, q.row_idx ORDER BY abs(c.tvt - q.tvt), c.tvt) AS r FROM q JOIN c USING (curve_id))
SELECT well_id, row_idx, tvt AS nearest_tvt, gr AS nearest_gr FROM n WHERE r = 1""")
def j3b(spark, sf_dir):
    return L.nearest_place(queries_of(spark, sf_dir), curves(spark, sf_dir), "curve_id", "at").select("well_id", "row_idx", "nearest_tvt", "nearest_gr")


@query("j3c_next_place", f"""WITH {WELLS}, {CURVES}, {Q}
SELECT well_id, row_idx, coalesce(min(c.tvt) FILTER (WHERE c.tvt >= q.tvt), max(c.tvt)) AS next_tvt FROM q JOIN c USING (curve_id) GROUP BY well_id, row_idx""")
def j3c(spark, sf_dir):
    return L.next_place(queries_of(spark, sf_dir), curves(spark, sf_dir), "curve_id", "at").select("well_id", "row_idx", "next_tvt")


OFFSETS = (-6.0, -3.0, 0.0, 3.0, 6.0)


@query("j11_offset_misfits", f"""WITH {WELLS}, {CURVES}, {SEG}, {ENDS}, {Q},
f AS (SELECT well_id, row_idx, curve_id, gr, o AS "offset", tvt + o AS t FROM q, (SELECT unnest([-6.0, -3.0, 0.0, 3.0, 6.0]::DOUBLE[]) AS o))
SELECT well_id, row_idx, "offset", round(gr - CASE WHEN t < lo THEN glo WHEN t >= hi THEN ghi ELSE g0 + (g1 - g0) * (t - t0) / (t1 - t0) END, 5) AS misfit
FROM f JOIN b USING (curve_id) LEFT JOIN s ON s.curve_id = f.curve_id AND t >= t0 AND t < t1""")
def j11(spark, sf_dir):
    out = L.offset_misfits(queries_of(spark, sf_dir), curves(spark, sf_dir), "curve_id", "at", "obs", list(OFFSETS))
    return out.select("well_id", "row_idx", "offset", R(F.col("misfit"), 5).alias("misfit"))


@query("w21_window_average", f"""WITH {WELLS}, {CURVES}, {SEG}, {ENDS}, {Q},
i AS (SELECT q.well_id, q.row_idx, q.tvt - 2.5 AS a, q.tvt + 2.5 AS z, lo, hi, greatest(t0, q.tvt - 2.5) AS x0, least(t1, q.tvt + 2.5) AS x1, t0, t1, g0, g1
      FROM q JOIN b USING (curve_id) JOIN s ON s.curve_id = q.curve_id AND t1 > q.tvt - 2.5 AND t0 < q.tvt + 2.5),
w AS (SELECT well_id, row_idx, sum((x1 - x0) * ((g0 + (g1 - g0) * (x0 - t0) / (t1 - t0)) + (g0 + (g1 - g0) * (x1 - t0) / (t1 - t0))) / 2) / 5.0 AS v FROM i WHERE a >= lo AND z <= hi GROUP BY ALL)
SELECT q.well_id, q.row_idx, round(v, 6) AS v FROM q LEFT JOIN w ON w.well_id = q.well_id AND w.row_idx = q.row_idx""")
def w21(spark, sf_dir):
    out = L.window_average(queries_of(spark, sf_dir), curves(spark, sf_dir), "curve_id", "at", 2.5)
    return out.select("well_id", "row_idx", R(F.col("curve_average"), 6).alias("v"))


@query("p12_likelihoods", """SELECT event_id, round(greatest(exp(-least(z * z, 600) / 2), 1e-300), 9) AS gauss, round(pow(1 + z * z / 4, -2.5), 9) AS student, round(1 / (1 + z * z), 9) AS cauchy,
 round(exp(-CASE WHEN abs(z) <= 1.5 THEN z * z / 2 ELSE 1.5 * (abs(z) - 0.75) END), 9) AS huber FROM (SELECT event_id, (value - 50) / 20.0 AS z FROM events)""")
def p12(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", ((F.col("value") - 50) / 20.0).alias("z"))
    return e.select("event_id", *[R(v, 9).alias(k) for k, v in L.likelihoods(F.col("z")).items()])


@query("p7_range_mask", f"""WITH {WELLS}, {CURVES}, b AS (SELECT curve_id, min(gr) AS lo, max(gr) AS hi FROM c GROUP BY curve_id)
SELECT well_id, row_idx, CASE WHEN gr * 10 BETWEEN lo AND hi THEN gr * 10 END AS gr FROM h JOIN b USING (curve_id)""")
def p7(spark, sf_dir):
    b = curves(spark, sf_dir).groupBy("curve_id").agg(F.min("gr").alias("lo"), F.max("gr").alias("hi"))
    return wells(spark, sf_dir).join(b, "curve_id").select("well_id", "row_idx", C.within(F.col("gr") * 10, F.col("lo"), F.col("hi")).alias("gr"))


KNN = """sc AS (SELECT stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM pts),
kq AS (SELECT well_id, well_id * 1000 + row_idx AS query_id, x, y FROM h),
ka AS (SELECT query_id, min(struct_pack(d := round(dist, 9), p := point_id), 10) AS near FROM (
 SELECT q.query_id, p.point_id, sqrt((p.x / sx - q.x / sx) * (p.x / sx - q.x / sx) + (p.y / sy - q.y / sy) * (p.y / sy - q.y / sy)) AS dist
 FROM kq q, pts p, sc WHERE q.well_id <> p.well_id) GROUP BY query_id),
ku AS (SELECT query_id, unnest(near).p AS point_id, unnest(range(1, len(near) + 1))::INTEGER AS rank FROM ka),
kk AS (SELECT ku.query_id, ku.rank, p.point_id, p.value, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy,
 sqrt((p.x / sx - q.x / sx) * (p.x / sx - q.x / sx) + (p.y / sy - q.y / sy) * (p.y / sy - q.y / sy)) AS dist
 FROM ku JOIN kq q USING (query_id) JOIN pts p USING (point_id), sc)"""


def near_points(spark, sf_dir, k=10):
    """Queries and their neighbours, keyed by the pair of well and row; ``numbered`` gives the number that the SQL makes of a pair."""
    p = points(spark, sf_dir).withColumn("point_id", F.struct("well_id", (F.col("point_id") - F.col("well_id") * 100000).alias("row_idx")))
    sx, sy, extent = P.axis_scales(p)
    q = wells(spark, sf_dir).select("well_id", F.struct("well_id", "row_idx").alias("query_id"), "x", "y")
    return q, P.knn_join(q, p, k, exclude=("well_id", "well_id"), sx=sx, sy=sy, extent=extent)


def numbered(key: str, rows: int):
    return (F.col(f"{key}.well_id") * rows + F.col(f"{key}.row_idx")).alias(key)


@query("j4_knn_other_wells", f"WITH {WELLS}, {POINTS}, {KNN} SELECT query_id, rank, point_id, round(dist, 6) AS dist FROM kk")
def j4(spark, sf_dir):
    return near_points(spark, sf_dir)[1].select(numbered("query_id", 1000), "rank", numbered("point_id", 100000), R(F.col("dist")).alias("dist"))


@query("j4_idw", f"""WITH {WELLS}, {POINTS}, {KNN}, w AS (SELECT *, 1 / pow(dist + 1e-3, 1.0) AS w FROM kk)
SELECT query_id, round(sum(w * value) / sum(w), 5) AS idw, round(sqrt(greatest(sum(w * value * value) / sum(w) - pow(sum(w * value) / sum(w), 2), 0)), 4) AS spread, round(min(dist), 6) AS nearest, count(*) AS n_near
FROM w GROUP BY query_id""")
def j4_idw(spark, sf_dir):
    d = P.inverse_distance(near_points(spark, sf_dir)[1])
    return d.select(numbered("query_id", 1000), R(F.col("idw"), 5).alias("idw"), R(F.col("spread"), 4).alias("spread"), R(F.col("nearest")).alias("nearest"), "n_near")


@query("j6_idw_power_two", f"""WITH {WELLS}, {POINTS}, {KNN}, w AS (SELECT *, 1 / pow(greatest(dist, 1e-6), 2.0) AS w FROM kk)
SELECT query_id, round(sum(w * value) / sum(w), 5) AS idw FROM w GROUP BY query_id""")
def j6(spark, sf_dir):
    d = P.inverse_distance(near_points(spark, sf_dir)[1], power=2.0, offset=0.0, floor=1e-6)
    return d.select(numbered("query_id", 1000), R(F.col("idw"), 5).alias("idw"))


@query("j5_local_plane", f"""WITH {WELLS}, {POINTS}, {KNN}, w AS (SELECT query_id, 1 / (dist + 1e-3) AS w, px - qx AS u, py - qy AS v, value AS z FROM kk),
m AS (SELECT query_id, sum(w) AS s0, sum(w*u) AS su, sum(w*v) AS sv, sum(w*u*u) AS suu, sum(w*u*v) AS suv, sum(w*v*v) AS svv, sum(w*z) AS sz, sum(w*u*z) AS suz, sum(w*v*z) AS svz FROM w GROUP BY query_id),
d AS (SELECT *, s0 * (suu * svv - suv * suv) - su * (su * svv - suv * sv) + sv * (su * suv - suu * sv) AS det FROM m)
SELECT query_id, CASE WHEN abs(det) > 1e-9 * abs(s0 * suu * svv) THEN round((sz * (suu * svv - suv * suv) - su * (suz * svv - suv * svz) + sv * (suz * suv - suu * svz)) / det, 3) END AS plane FROM d""")
def j5(spark, sf_dir):
    q, near = near_points(spark, sf_dir)
    return P.local_plane(near, q).select(numbered("query_id", 1000), R(F.col("plane"), 3).alias("plane"))


@query("j8_fold_exclusion", f"WITH {WELLS} SELECT well_id, count(*) AS n FROM h WHERE well_id % 5 <> 2 GROUP BY well_id")
def j8(spark, sf_dir):
    from strataflow.operators import crossfit as X

    return X.outside_fold(wells(spark, sf_dir), X.modulo_folds(wells(spark, sf_dir), "well_id", 5), "well_id", 2).groupBy("well_id").agg(F.count(F.lit(1)).alias("n"))


@query("j9_neighbour_wells", f"""WITH {WELLS}, a AS (SELECT well_id, avg(x) AS x, avg(y) AS y FROM h GROUP BY well_id),
n AS (SELECT a.well_id, b.well_id AS other, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d FROM a, a b WHERE a.well_id <> b.well_id),
r AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY round(d, 9), other)::INTEGER AS rank FROM n) SELECT well_id, rank, other, round(d, 5) AS dist FROM r WHERE rank <= 6""")
def j9(spark, sf_dir):
    c = P.centroids(wells(spark, sf_dir))
    near = P.knn_join(c.withColumnRenamed("well_id", "query_id").withColumn("well", F.col("query_id")), c.select(F.col("well_id").alias("point_id"), F.lit(0.0).alias("value"), "x", "y", F.col("well_id").alias("w")), 6, exclude=("well", "w"))
    return near.select(F.col("query_id").alias("well_id"), "rank", F.col("point_id").alias("other"), R(F.col("dist"), 5).alias("dist"))


@query("p10_fourier", f"WITH {WELLS} SELECT well_id, row_idx, round(sin(x * 2 * pi() * 0.01), 6) + 0.0 AS s, round(cos(x * 2 * pi() * 0.01), 6) + 0.0 AS c FROM h")
def p10(spark, sf_dir):
    s, c = C.fourier(F.col("x"), 0.01)
    return wells(spark, sf_dir).select("well_id", "row_idx", R(s).alias("s"), R(c).alias("c"))


@query("p11_rotate", f"WITH {WELLS} SELECT well_id, row_idx, round(x * cos(radians(50)) + y * sin(radians(50)), 5) AS ax, round((y * cos(radians(50)) - x * sin(radians(50))) * 1.3, 5) AS ay FROM h")
def p11(spark, sf_dir):
    return P.rotate(wells(spark, sf_dir), 50.0, 1.3).select("well_id", "row_idx", R(F.col("ax"), 5).alias("ax"), R(F.col("ay"), 5).alias("ay"))


@query("j1_sidecar_join", """SELECT o_orderkey, round(s.total, 4) AS total, coalesce(s.n, 0) AS n FROM orders LEFT JOIN
 (SELECT l_orderkey, sum(l_extendedprice) AS total, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY l_orderkey) s ON s.l_orderkey = o_orderkey""")
def j1(spark, sf_dir):
    from strataflow.operators.contracts import sidecar

    s = table(spark, sf_dir, "lineitem").where("l_quantity > 40").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("total"), F.count(F.lit(1)).alias("n"))
    out = sidecar(table(spark, sf_dir, "orders").select("o_orderkey"), s, ["o_orderkey"])
    return out.select("o_orderkey", R(F.col("total"), 4).alias("total"), F.coalesce("n", F.lit(0)).alias("n"))


@query("j2_many_to_one", """SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""")
def j2(spark, sf_dir):
    from strataflow.operators.contracts import many_to_one

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    j = many_to_one(table(spark, sf_dir, "orders"), c, ["o_custkey"])
    j = many_to_one(j, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), R(F.sum("o_totalprice"), 2).alias("total"))


@query("j10_aligned_repeats", """WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, round(a.v, 2) AS a, round(b.v, 2) AS b, a.k IS NOT NULL AND b.k IS NOT NULL AS in_both FROM a FULL JOIN b ON a.k = b.k""")
def j10(spark, sf_dir):
    from strataflow.operators.contracts import align

    o = table(spark, sf_dir, "orders")
    part = lambda i: o.where(F.col("o_orderkey") % 2 == i).groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("v"))
    return align(part(0), part(1), "k", "v").select("k", R(F.col("a"), 2).alias("a"), R(F.col("b"), 2).alias("b"), "in_both")
