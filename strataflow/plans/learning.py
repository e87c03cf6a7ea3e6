"""Queries of sources, sinks, learners, simulation and the remaining candidate operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataflow.functions import columns as C
from strataflow.operators import candidates as V
from strataflow.operators import crossfit as X
from strataflow.operators import sequence as S
from strataflow.operators.order import running
from strataflow.plans.proxies import CURVES, PREDICTIONS, SCORED, WELLS, curves, predictions, scored, wells
from strataflow.plans.registry import query
from strataflow.sources import wells as io
from strataflow.tables import table

R = lambda c, n=6: F.round(c, n)


@query("s1_scan_logs", f"WITH {WELLS} SELECT CAST(well_id AS VARCHAR) AS well_id, count(*) AS n, count(gr) AS n_gr, round(sum(md), 3) AS md, round(sum(tvt_input), 3) AS tvt FROM h GROUP BY well_id")
def s1(spark, sf_dir):
    path = io.folder(spark, "logs")
    io.write_logs(wells(spark, sf_dir).repartition("well_id"), path)
    return io.scan_logs(spark, path).groupBy("well_id").agg(F.count(F.lit(1)).alias("n"), F.count("gr").alias("n_gr"), R(F.sum("md"), 3).alias("md"), R(F.sum("tvt_input"), 3).alias("tvt"))


@query("s2_pruned_scan", "SELECT l_suppkey, max(l_quantity) AS q FROM lineitem WHERE l_discount >= 0.05 GROUP BY l_suppkey")
def s2(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_discount >= 0.05").groupBy("l_suppkey").agg(F.max("l_quantity").alias("q"))


@query("s3_discover_wells", f"WITH {WELLS} SELECT DISTINCT well_id FROM h")
def s3(spark, sf_dir):
    return io.discover(wells(spark, sf_dir))


@query("s4_log_with_curve", f"WITH {WELLS}, {CURVES}, n AS (SELECT curve_id, count(*) AS points FROM c GROUP BY curve_id) SELECT well_id, count(*) AS n_rows, any_value(points) AS points FROM h JOIN n USING (curve_id) GROUP BY well_id")
def s4(spark, sf_dir):
    from strataflow.operators.decode import pack

    return pack(wells(spark, sf_dir), curves(spark, sf_dir)).select("well_id", F.size("md").cast("long").alias("n_rows"), F.size("curve_t").cast("long").alias("points"))


@query("s5_feature_cache", f"WITH {WELLS} SELECT well_id, count(*) AS n, round(avg(z), 6) AS z FROM h GROUP BY well_id")
def s5(spark, sf_dir):
    build = lambda: wells(spark, sf_dir).groupBy("well_id").agg(F.count(F.lit(1)).alias("n"), R(F.avg("z")).alias("z"))
    root = io.folder(spark, "features")
    about = {"files": io.files_digest(table(spark, sf_dir, "events")), "version": 1}
    io.cached(spark, build, root, **about)
    return io.cached(spark, build, root, **about)


@query("s6_path_arrays", f"WITH {WELLS} SELECT well_id, row_idx, md FROM h")
def s6(spark, sf_dir):
    a = wells(spark, sf_dir).groupBy("well_id").agg(F.sort_array(F.collect_list(F.struct("row_idx", "md"))).alias("p"))
    return a.select("well_id", F.explode("p").alias("p")).select("well_id", "p.row_idx", "p.md")


@query("s7_coverage", "SELECT c_custkey AS key, 'missing' AS problem FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def s7(spark, sf_dir):
    from strataflow.operators.contracts import coverage

    got = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    return coverage(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), got, "key")


@query("s8_masked_copy", f"WITH {WELLS} SELECT well_id, count(*) AS n, count(CASE WHEN row_idx < 20 THEN tvt_input END) AS known FROM h GROUP BY well_id")
def s8(spark, sf_dir):
    m = io.masked(wells(spark, sf_dir), F.lit(20))
    assert not set(m.columns) & set(io.FORBIDDEN)
    return m.groupBy("well_id").agg(F.count(F.lit(1)).alias("n"), F.count("tvt_input").alias("known"))


@query("s9_group_hash", "SELECT o_custkey, md5(array_to_string(list_sort(list(CAST(o_orderkey AS VARCHAR))), ',')) AS digest FROM orders GROUP BY o_custkey")
def s9(spark, sf_dir):
    return io.group_hash(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


@query("s9_frame_hash", "SELECT count(*) AS rows, CAST(sum(CAST(CAST('0x' || substr(md5(c_custkey || '|' || c_mktsegment), 1, 12) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM customer")
def s9_frame(spark, sf_dir):
    return io.frame_hash(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"])


@query("s10_submission", f"WITH {WELLS}, p AS (SELECT well_id, row_idx, CASE WHEN row_idx % 6 <> 5 THEN tvt END AS t FROM h) SELECT well_id || '_' || row_idx AS id, coalesce(t, last_value(t IGNORE NULLS) OVER (PARTITION BY well_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS tvt FROM p")
def s10(spark, sf_dir):
    h = wells(spark, sf_dir)
    return io.submission(h, h.where("row_idx % 6 <> 5"))


@query("s11_tail_padding", f"WITH {WELLS}, l AS (SELECT well_id, arg_max(tvt_input, row_idx) AS l FROM h WHERE tvt_input IS NOT NULL GROUP BY well_id) SELECT h.well_id, row_idx, coalesce(tvt_input, l) AS tvt FROM h JOIN l USING (well_id)")
def s11(spark, sf_dir):
    h = S.anchors(wells(spark, sf_dir), "tvt_input").where("last_tvt_input is not null")
    return h.select("well_id", "row_idx", F.coalesce("tvt_input", "last_tvt_input").alias("tvt"))


@query("p4_linear_extrapolation", f"""WITH {WELLS}, k AS (SELECT well_id, arg_max(tvt_input, row_idx) AS l, arg_max(md, row_idx) AS m, regr_slope(tvt_input, md) AS s FROM h WHERE tvt_input IS NOT NULL GROUP BY well_id)
SELECT h.well_id, row_idx, round(l + s * (md - m), 6) AS v FROM h JOIN k USING (well_id) WHERE tvt_input IS NULL""")
def p4(spark, sf_dir):
    from strataflow.operators.aggregates import robust_slope

    h = S.anchors(wells(spark, sf_dir), "tvt_input", "md").where("last_md is not null")
    s = h.groupBy("well_id").agg(robust_slope("tvt_input", "md", F.col("tvt_input").isNotNull()).alias("s"))
    v = F.col("last_tvt_input") + F.col("s") * (F.col("md") - F.col("last_md"))
    return h.where("tvt_input is null").join(s, "well_id").select("well_id", "row_idx", R(v).alias("v"))


@query("w20_segment_means", f"WITH {WELLS}, b AS (SELECT well_id, row_idx // 8 AS seg, avg(tvt) AS m FROM h GROUP BY ALL) SELECT h.well_id, row_idx, round(m, 6) AS m FROM h JOIN b ON b.well_id = h.well_id AND b.seg = h.row_idx // 8")
def w20(spark, sf_dir):
    w = W.partitionBy("well_id", F.floor(F.col("row_idx") / 8))
    return wells(spark, sf_dir).select("well_id", "row_idx", R(F.avg("tvt").over(w)).alias("m"))


@query("w26_slices", f"WITH {WELLS}, c AS (SELECT well_id, count(*) AS n FROM h GROUP BY well_id) SELECT well_id, coalesce(sum(n) OVER (ORDER BY well_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, n FROM c")
def w26(spark, sf_dir):
    c = wells(spark, sf_dir).groupBy("well_id").agg(F.count(F.lit(1)).alias("n"))
    return running(c, [F.col("well_id")], {"start": F.col("n")}).select("well_id", F.col("start").cast("long").alias("start"), "n")


@query("j7_two_level_prior", f"""WITH {WELLS}, a AS (SELECT well_id, avg(x) AS x, avg(y) AS y, avg(tvt + z) AS s FROM h GROUP BY well_id),
n AS (SELECT a.well_id, b.well_id AS o, b.s, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM a, a b WHERE a.well_id <> b.well_id), r AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY round(d, 9), o) AS k FROM n)
SELECT well_id, round(sum(s / pow(greatest(d, 1e-6), 2)) / sum(1 / pow(greatest(d, 1e-6), 2)), 4) AS prior FROM r WHERE k <= 12 GROUP BY well_id""")
def j7(spark, sf_dir):
    from strataflow.operators import spatial as P

    c = wells(spark, sf_dir).groupBy("well_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg(F.col("tvt") + F.col("z")).alias("value"))
    q = c.select(F.col("well_id").alias("query_id"), F.col("well_id").alias("w"), "x", "y")
    near = P.knn_join(q, c.select(F.col("well_id").alias("point_id"), "value", "x", "y", F.col("well_id").alias("o")), 12, exclude=("w", "o"))
    return P.inverse_distance(near, power=2.0, offset=0.0, floor=1e-6).select(F.col("query_id").alias("well_id"), R(F.col("idw"), 4).alias("prior"))


@query("j7_local_gradient", f"""WITH {WELLS}, a AS (SELECT well_id, avg(x) AS x, avg(y) AS y FROM h GROUP BY well_id),
n AS (SELECT a.well_id, b.well_id AS other, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d FROM a, a b WHERE a.well_id <> b.well_id),
s AS (SELECT well_id, other FROM (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY round(d, 9), other) AS r FROM n) WHERE r <= 12),
t AS (SELECT well_id, row_idx, x, y, x - lag(x) OVER o AS dx, y - lag(y) OVER o AS dy, tvt + z - lag(tvt + z) OVER o AS ds FROM h WINDOW o AS (PARTITION BY well_id ORDER BY row_idx)),
m AS (SELECT q.well_id, q.row_idx, s.other, t.row_idx AS prow, t.dx, t.dy, t.ds, sqrt((q.x - t.x) * (q.x - t.x) + (q.y - t.y) * (q.y - t.y)) AS dist
      FROM h q JOIN s USING (well_id) JOIN t ON t.well_id = s.other AND t.ds IS NOT NULL WHERE q.tvt_input IS NULL),
k AS (SELECT *, 1 / (greatest(dist, 1e-6) * greatest(dist, 1e-6)) AS w FROM (SELECT *, row_number() OVER (PARTITION BY well_id, row_idx ORDER BY round(dist, 9), other, prow) AS r FROM m) WHERE r <= 112),
f AS (SELECT well_id, row_idx, sum(w*dx*dx) AS xx, sum(w*dx*dy) AS xy, sum(w*dy*dy) AS yy, sum(w*dx*ds) AS xs, sum(w*dy*ds) AS ys FROM k GROUP BY ALL),
g AS (SELECT well_id, row_idx, CASE WHEN xx*yy - xy*xy > 1e-6*xx*yy THEN (xs*yy - ys*xy) / (xx*yy - xy*xy) END AS gx,
      CASE WHEN xx*yy - xy*xy > 1e-6*xx*yy THEN (ys*xx - xs*xy) / (xx*yy - xy*xy) END AS gy FROM f),
u AS (SELECT k.*, g.gx, g.gy, (ds - gx*dx - gy*dy) / 3.0 AS u FROM k JOIN g USING (well_id, row_idx)),
v AS (SELECT *, CASE WHEN abs(u) < 1 THEN w * (1 - u*u) * (1 - u*u) ELSE 0 END AS w2 FROM u),
v2 AS (SELECT well_id, row_idx, any_value(gx) AS gx, any_value(gy) AS gy, sum(w2*dx*dx) AS xx, sum(w2*dx*dy) AS xy, sum(w2*dy*dy) AS yy, sum(w2*dx*ds) AS xs, sum(w2*dy*ds) AS ys FROM v GROUP BY ALL)
SELECT well_id, row_idx, round(CASE WHEN xx*yy - xy*xy > 1e-6*xx*yy THEN (xs*yy - ys*xy) / (xx*yy - xy*xy) ELSE gx END, 6) + 0.0 AS gx,
 round(CASE WHEN xx*yy - xy*xy > 1e-6*xx*yy THEN (ys*xx - xs*xy) / (xx*yy - xy*xy) ELSE gy END, 6) + 0.0 AS gy FROM v2""")
def j7_gradient(spark, sf_dir):
    """The second level of the spatial prior: of the 12 nearest wells, the 112 nearest steps at every hidden row."""
    from strataflow.operators import spatial as P

    o = W.partitionBy("well_id").orderBy("row_idx")
    s = F.col("tvt") + F.col("z")
    step = lambda v: v - F.lag(v).over(o)
    h = P.cut(wells(spark, sf_dir).select("well_id", "row_idx", "x", "y", F.col("tvt_input").isNull().alias("hidden"), step(F.col("x")).alias("dx"), step(F.col("y")).alias("dy"), step(s).alias("ds")))
    c = h.groupBy("well_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    q = c.select(F.col("well_id").alias("query_id"), F.col("well_id").alias("w"), "x", "y")
    near = P.knn_join(q, c.select(F.col("well_id").alias("point_id"), F.lit(0.0).alias("value"), "x", "y", F.col("well_id").alias("o")), 12, exclude=("w", "o"))
    support = P.cut(near.select(F.col("query_id").alias("well_id"), F.col("point_id").alias("other")))
    g = P.local_gradient(h.where("hidden"), support, h.where("ds is not null"))
    return g.select("well_id", "row_idx", (R(F.col("gx")) + 0.0).alias("gx"), (R(F.col("gy")) + 0.0).alias("gy"))


@query(
    "c2_rate_candidates",
    f"""WITH {WELLS}, t AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY row_idx DESC) AS back, count(*) OVER (PARTITION BY well_id) AS known FROM h WHERE tvt_input IS NOT NULL),
v AS (SELECT DISTINCT well_id, unnest([32, 64, 128, 256, 512, known]) AS win FROM t),
s AS (SELECT t.well_id, win, coalesce(regr_slope(tvt_input + z, md), 0) AS s FROM t JOIN v ON v.well_id = t.well_id AND back <= win GROUP BY ALL),
l AS (SELECT well_id, arg_max(tvt_input + z, row_idx) AS u, arg_max(md, row_idx) AS m, arg_max(tvt_input, row_idx) AS lv FROM t GROUP BY well_id HAVING count(*) >= 2),
o AS (SELECT unnest([-0.012, -0.006, 0, 0.006, 0.012]::DOUBLE[]) AS o), b AS (SELECT unnest([0, 0.5]::DOUBLE[]) AS b),
x AS (SELECT h.well_id, win, o, b, row_idx, u + (s + o) * (md - m) - z AS line, lv + 0.125 * row_idx AS anchor FROM h JOIN s USING (well_id) JOIN l USING (well_id) CROSS JOIN o CROSS JOIN b WHERE tvt_input IS NULL),
g AS (SELECT well_id, win, o, b, avg(line) AS ml, avg(anchor) AS ma, max(row_idx) AS last FROM x GROUP BY ALL)
SELECT well_id, win AS "window", o AS "offset", b AS blend, round((1 - b) * ml + b * ml, 5) AS level,
  round((1 - b) * line + b * (ml + anchor - ma), 5) AS last FROM x JOIN g USING (well_id, win, o, b) WHERE row_idx = g.last""",
)
def c2(spark, sf_dir):
    """All windows, offsets and blends; the mean level of each candidate and its last one."""
    h = S.anchors(wells(spark, sf_dir), "tvt_input").withColumn("anchor", F.col("last_tvt_input") + 0.125 * F.col("row_idx"))
    c = V.rate_candidates(h, "anchor")
    return c.groupBy("well_id", "window", "offset", "blend").agg(R(F.avg("tvt"), 5).alias("level"), R(F.max_by("tvt", "row_idx"), 5).alias("last"))


@query(
    "c5_piecewise_candidates",
    f"""WITH {WELLS}, a AS (SELECT *, arg_max(tvt_input, row_idx) FILTER (WHERE tvt_input IS NOT NULL) OVER w AS l, arg_max(z, row_idx) FILTER (WHERE tvt_input IS NOT NULL) OVER w AS z0,
  arg_max(md, row_idx) FILTER (WHERE tvt_input IS NOT NULL) OVER w AS m0 FROM h WINDOW w AS (PARTITION BY well_id)),
i AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY row_idx) - 1 AS i, count(*) OVER (PARTITION BY well_id) AS nh FROM a WHERE tvt_input IS NULL AND l IS NOT NULL),
k AS (SELECT well_id, j, CAST(floor(j * (nh - 1) / 11.0::DOUBLE) AS BIGINT) AS i FROM (SELECT DISTINCT well_id, nh FROM i), (SELECT unnest(range(0, 12)) AS j)),
ee AS (SELECT unnest([-24, -12, 0, 12, 24]::DOUBLE[]) AS e), s AS (SELECT unnest([-0.012, 0, 0.012]::DOUBLE[]) AS s), c AS (SELECT unnest([-10, 0, 10]::DOUBLE[]) AS c),
p AS (SELECT k.well_id, j, k.i, e, s, c, l + e * (j / 11.0) + s * (md - m0) + c * 4 * (j / 11.0) * (1 - j / 11.0) AS v FROM k JOIN i ON i.well_id = k.well_id AND i.i = k.i CROSS JOIN ee CROSS JOIN s CROSS JOIN c),
q AS (SELECT p.*, lead(i) OVER o AS i1, lead(v) OVER o AS v1 FROM p WINDOW o AS (PARTITION BY well_id, e, s, c ORDER BY j)),
r AS (SELECT i.well_id, i.row_idx, e, s, c, CASE WHEN i1 IS NULL THEN v ELSE v + (v1 - v) * (i.i - q.i) / (i1 - q.i) END AS t
  FROM i JOIN q ON q.well_id = i.well_id AND i.i >= q.i AND (i.i < i1 OR (i1 IS NULL AND i.i = q.i)))
SELECT well_id, e AS "end", s AS slope, c AS curvature, round(avg(t), 5) AS level, round(max(t) - min(t), 5) AS swing FROM r GROUP BY ALL""",
)
def c5(spark, sf_dir):
    """Endpoints, slopes and curvatures at twelve knots, lines between; mean level and swing of each candidate."""
    h = S.anchors(wells(spark, sf_dir), "tvt_input", "md")
    c = V.piecewise_candidates(h)
    return c.groupBy("well_id", "end", "slope", "curvature").agg(R(F.avg("tvt"), 5).alias("level"), R(F.max("tvt") - F.min("tvt"), 5).alias("swing"))


@query("c6_score_paths", f"""WITH {WELLS}, {CURVES}, s AS (SELECT h.well_id, o, gr - v AS r FROM (SELECT well_id, curve_id, gr, round(tvt + o) AS t, o FROM h, (SELECT unnest([-5, 0, 5]::DOUBLE[]) AS o) WHERE gr IS NOT NULL) h JOIN (SELECT curve_id, tvt, gr / 20.0 AS v FROM c) c ON c.curve_id = h.curve_id AND c.tvt = h.t)
SELECT well_id, o AS "offset", count(*) AS n, round(sqrt(avg(r * r)), 6) AS rms, round(avg(CASE WHEN abs(r) / 20 <= 1 THEN pow(abs(r) / 20, 2) / 2 ELSE abs(r) / 20 - 0.5 END), 6) AS huber FROM s GROUP BY ALL""")
def c6(spark, sf_dir):
    from strataflow.operators.aggregates import huber

    h = wells(spark, sf_dir).where("gr is not null").withColumn("offset", F.explode(F.array(*[F.lit(float(o)) for o in (-5, 0, 5)])))
    c = curves(spark, sf_dir).select("curve_id", F.col("tvt").alias("t"), (F.col("gr") / 20.0).alias("v"))
    j = h.withColumn("t", F.round(F.col("tvt") + F.col("offset"))).join(c, ["curve_id", "t"]).withColumn("r", F.col("gr") - F.col("v"))
    return j.groupBy("well_id", "offset").agg(F.count(F.lit(1)).alias("n"), R(F.sqrt(F.avg(F.col("r") * F.col("r")))).alias("rms"), R(F.avg(huber(F.col("r"), 20.0))).alias("huber"))


@query("c11_path_labels", f"WITH {PREDICTIONS} SELECT well, round(sqrt(avg((pred - y) * (pred - y))), 4) AS path_rmse, round(abs(avg(pred - y)), 4) AS level_error FROM p GROUP BY well")
def c11(spark, sf_dir):
    from strataflow.operators.aggregates import error_table

    return error_table(predictions(spark, sf_dir)).select("well", R(F.col("rmse"), 4).alias("path_rmse"), R(F.abs("bias"), 4).alias("level_error"))


@query(
    "c17_member_sidecar",
    f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, cand) AS r, floor(delta / 6) AS bin FROM k),
b AS (SELECT grp, bin, max(score) AS best, count(*) AS n, row_number() OVER (PARTITION BY grp ORDER BY max(score) DESC, bin) AS r FROM r GROUP BY grp, bin),
t AS (SELECT grp, max(score) FILTER (WHERE r = 1) AS top1, max(score) FILTER (WHERE r = 2) AS top2, max(delta) FILTER (WHERE r = 1) AS d1, max(delta) FILTER (WHERE r = 2) AS d2,
  max(family) FILTER (WHERE r = 1) AS f1, max(family) FILTER (WHERE r = 2) AS f2, count(*) AS n FROM r GROUP BY grp),
near AS (SELECT r.grp, count(*) AS near FROM r JOIN t USING (grp) WHERE score >= top1 - 25 AND r.r > 1 GROUP BY r.grp),
c AS (SELECT grp, max(best) FILTER (WHERE r = 1) - max(best) FILTER (WHERE r = 2) AS gap, max(n) FILTER (WHERE r = 1) AS members, count(*) AS clusters FROM b GROUP BY grp)
SELECT grp, n, top1, top1 - top2 AS margin, round(abs(d1 - d2), 6) AS apart, f1 = f2 AS same_family, coalesce(near, 0) AS near_ties, c.gap AS cluster_gap, c.members, c.clusters
FROM t JOIN c USING (grp) LEFT JOIN near USING (grp)""",
)
def c17(spark, sf_dir):
    """Of each group the best members, how far the second is, how many nearly tie, and the same for clusters of levels."""
    return V.member_sidecar(scored(spark, sf_dir), "grp", 6.0, 25.0)


@query("c17_top_gaps", "WITH r AS (SELECT o_custkey AS k, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) SELECT k, max(v) FILTER (WHERE r = 1) AS top1, max(v) FILTER (WHERE r = 2) AS top2, count(*) AS n FROM r GROUP BY k")
def c17(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"))
    # only a customer's first two rows of each task travel; the count is summed beside them
    first = o.withColumn("r", F.row_number().over(W.partitionBy("k").orderBy(F.desc("v")))).where("r <= 2")
    top = first.groupBy("k").agg(F.max("v").alias("top1"), F.max(F.when(F.col("r") == 2, F.col("v"))).alias("top2"))
    return top.join(o.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k")


@query("c20_mode_features", "SELECT vec_id, round(list_max(embedding), 6) AS high, round(list_min(embedding), 6) AS low, round(list_sort(embedding)[(len(embedding) + 1) // 2], 6) AS middle, CAST(len(list_filter(embedding, lambda v: v > 0)) AS INTEGER) AS positive FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)")
def c20(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("m"))
    return e.select("vec_id", R(F.array_max("m")).alias("high"), R(F.array_min("m")).alias("low"), R(F.get(F.array_sort("m"), F.floor((F.size("m") - 1) / 2).cast("int"))).alias("middle"), F.size(F.filter("m", lambda v: v > 0)).alias("positive"))


def lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("well"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), "l_quantity", "l_discount", "l_tax", F.when(F.col("l_linenumber") != 3, F.col("l_partkey") % 100).alias("gap"), "l_extendedprice")


def _learned(name, learner):
    @query(name)
    def q(spark, sf_dir):
        from strataflow.operators.learning import out_of_fold

        d = lines(spark, sf_dir)
        folds = X.modulo_folds(d, "well", 5)
        return out_of_fold(d, "well", folds, ["l_quantity", "l_discount", "l_tax", "gap"], "l_extendedprice", learner).select("well", "row", "fold", R(F.col("prediction"), 4).alias("prediction"))


_learned("x9_ridge_out_of_fold", "ridge")
_learned("c12_forest_out_of_fold", "forest")


@query("x1_place_folds")
def x1_place(spark, sf_dir):
    from strataflow.operators.learning import place_folds
    from strataflow.operators.spatial import centroids

    return place_folds(centroids(wells(spark, sf_dir)), "well_id")


#: Values that specifications are drawn from.
SPACE = {"step": (0.2, 0.5, 0.7), "rates": (31.0, 41.0), "reach": (80.0, 150.0)}


@query(
    "x11_random_specs",
    f"""WITH {WELLS}, d AS (SELECT well_id, draw FROM (SELECT DISTINCT well_id FROM h), (SELECT unnest(range(0, 6)) AS draw)),
s AS (SELECT well_id, draw, {", ".join(f"([{', '.join(map(str, v))}]::DOUBLE[])[1 + CAST(floor({C.hash_unit_sql('well_id', 'draw', repr(k))} * {len(v)}) AS BIGINT)] AS {k}" for k, v in SPACE.items())} FROM d)
SELECT well_id, min(draw) AS draw, step, rates, reach FROM s GROUP BY well_id, step, rates, reach""",
)
def x11(spark, sf_dir):
    """Six specifications drawn for each well; one that repeats counts once, by its first draw."""
    d = wells(spark, sf_dir).select("well_id").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    return X.drawn_specs(d, ["well_id"], "draw", SPACE)


@query("g1_simulated_logs")
def g1(spark, sf_dir):
    """Shifted, stretched, noisy and cut copies of the logs, each change drawn from a hash of well and copy."""
    u = lambda name: (F.pmod(F.xxhash64("well_id", "copy", F.lit(name)), F.lit(1 << 20)) / float(1 << 20))
    row = lambda name: (F.pmod(F.xxhash64("well_id", "copy", "row_idx", F.lit(name)), F.lit(1 << 20)) / float(1 << 20))
    h = wells(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    shifted = h.select(
        "well_id", "copy", "row_idx", (F.col("md") * (0.95 + 0.1 * u("stretch"))).alias("md"), (F.col("z") + 10 * (u("z") - 0.5)).alias("z"),
        (F.col("gr") + 5 * (row("noise") - 0.5)).alias("gr"), "tvt", (F.col("row_idx") < F.col("n") * (0.7 + 0.3 * u("cut"))).alias("kept"),
    )
    return shifted.where("kept").drop("kept")


@query(
    "g5_donor_audit",
    f"""WITH {WELLS}, a AS (SELECT well_id, avg(x) AS x, avg(y) AS y FROM h GROUP BY well_id),
n AS (SELECT a.well_id, b.well_id AS other, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d FROM a, a b WHERE a.well_id <> b.well_id),
r AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY round(d, 9), other) AS rank FROM n),
p AS (SELECT well_id, arg_min(other, {C.hash_unit_sql('well_id', 'other')}) AS donor FROM r WHERE rank <= 5 GROUP BY well_id)
SELECT donor, count(*) AS given FROM p GROUP BY donor""",
)
def g5(spark, sf_dir):
    """For each well a donor among its nearest wells, drawn by a hash, and how often each well gives."""
    from strataflow.operators import spatial as P

    c = P.centroids(wells(spark, sf_dir))
    q = c.select(F.col("well_id").alias("query_id"), F.col("well_id").alias("w"), "x", "y")
    near = P.knn_join(q, c.select(F.col("well_id").alias("point_id"), F.lit(0.0).alias("value"), "x", "y", F.col("well_id").alias("o")), 5, exclude=("w", "o"))
    pick = near.groupBy("query_id").agg(F.min_by("point_id", C.hash_unit("query_id", "point_id")).alias("donor"))
    return pick.groupBy("donor").agg(F.count(F.lit(1)).alias("given"))


@query(
    "g6_pseudo_split",
    f"""WITH {WELLS}, g AS (SELECT well_id, count(tvt_input) AS known FROM h GROUP BY well_id)
SELECT well_id, CAST(greatest(10, floor(known * (0.4 + 0.5 * {C.hash_unit_sql('well_id', "'split'")}))) AS BIGINT) AS split FROM g""",
)
def g6(spark, sf_dir):
    g = wells(spark, sf_dir).groupBy("well_id").agg(F.count("tvt_input").alias("known"))
    u = C.hash_unit("well_id", F.lit("split"))
    return g.select("well_id", F.greatest(F.lit(10), F.floor(F.col("known") * (0.4 + 0.5 * u))).cast("long").alias("split"))


@query("x6_fold_mean_recalibrated", "WITH f AS (SELECT p_partkey AS id, p_retailprice AS a, p_retailprice * 1.1 - 3 AS b, p_size AS y FROM part), m AS (SELECT id, (a + b) / 2 AS m, y FROM f), c AS (SELECT regr_slope(y, m) AS s, regr_intercept(y, m) AS i FROM m) SELECT id, round(i + s * m, 6) AS v FROM m, c")
def x6(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_retailprice") + (F.col("p_retailprice") * 1.1 - 3)) / 2).alias("m"), "p_size")
    c = p.agg(F.regr_slope("p_size", "m").alias("s"), F.regr_intercept("p_size", "m").alias("i"))
    return p.crossJoin(F.broadcast(c)).select("id", R(F.col("i") + F.col("s") * F.col("m")).alias("v"))
