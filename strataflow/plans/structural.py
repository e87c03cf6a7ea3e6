"""Queries of the choice of a path by structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.operators import sequence as S
from strataflow.operators import structural as K
from strataflow.plans.proxies import WELLS, wells
from strataflow.plans.registry import query

R = lambda c, n=6: F.round(c, n)
LEAST = 8

PARTS = f"""{WELLS}, s AS (SELECT *, CASE WHEN row_idx % 13 <> 5 THEN x * 0.125 - y * 0.0625 END AS surface FROM h),
f AS (SELECT well_id, avg(tvt_input + z - surface) AS off, arg_max(tvt_input, row_idx) FILTER (WHERE tvt_input IS NOT NULL) AS l, arg_max(md, row_idx) FILTER (WHERE tvt_input IS NOT NULL) AS m,
  regr_slope(tvt_input, md) AS sl FROM s GROUP BY well_id),
t AS (SELECT s.*, surface + off - z AS struct, l, l + sl * (md - m) AS line, l + 0.5 * sl * (md - m) AS half, l + 0.02 * (md - m) AS up FROM s JOIN f USING (well_id)),
c AS (SELECT well_id, row_idx, struct, 0.55 * l + 0.45 * line AS base, half, unnest(['hold', 'line', 'half', 'up']) AS item, unnest([1, 2, 3, 4]) AS rank, unnest([l, line, half, up]) AS pred FROM t WHERE tvt_input IS NULL),
w AS (SELECT well_id, item, rank, avg(pred) AS level, avg(struct) AS s0, avg(pred - struct) AS d, avg((pred - struct) * (pred - struct)) AS dd, avg(abs(pred - base)) AS base_abs FROM c GROUP BY ALL),
a AS (SELECT well_id, item, rank, level, base_abs, sqrt(dd) AS path_rmse, abs(level - s0) AS struct_abs, sqrt(greatest(dd - 2 * (level - s0) * d + (level - s0) * (level - s0), 0)) AS shape_rmse FROM w WHERE dd IS NOT NULL),
m1 AS (SELECT *, median(path_rmse) OVER g AS mp, median(shape_rmse) OVER g AS ms, median(base_abs) OVER g AS mb, stddev_pop(path_rmse) OVER g AS sp, stddev_pop(shape_rmse) OVER g AS ss, stddev_pop(base_abs) OVER g AS sb FROM a WINDOW g AS (PARTITION BY well_id)),
m2 AS (SELECT *, median(abs(path_rmse - mp)) OVER g AS dp, median(abs(shape_rmse - ms)) OVER g AS ds, median(abs(base_abs - mb)) OVER g AS db FROM m1 WINDOW g AS (PARTITION BY well_id)),
z AS (SELECT *, (path_rmse - mp) / CASE WHEN dp > 1e-9 THEN 1.4826 * dp ELSE sp + 1e-6 END + 0.5 * (shape_rmse - ms) / CASE WHEN ds > 1e-9 THEN 1.4826 * ds ELSE ss + 1e-6 END
  + 0.5 * (base_abs - mb) / CASE WHEN db > 1e-9 THEN 1.4826 * db ELSE sb + 1e-6 END AS cost FROM m2),
b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY well_id ORDER BY round(cost, 9), rank, item) = 1)"""

REPLAYS = f"""k AS (SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY row_idx) - 1 AS i, count(*) OVER (PARTITION BY well_id) AS ps FROM s WHERE tvt_input IS NOT NULL),
v AS (SELECT k.*, cut FROM k, LATERAL (SELECT DISTINCT CAST(round(ps * q) AS INTEGER) AS cut FROM (SELECT unnest([0.45, 0.60, 0.75, 0.85]) AS q)) WHERE cut >= {LEAST} AND ps - cut >= {LEAST}),
o AS (SELECT well_id, cut, avg(CASE WHEN i < cut THEN tvt_input + z - surface END) AS off, max(CASE WHEN i = cut - 1 THEN tvt_input END) AS last FROM v GROUP BY ALL),
p AS (SELECT v.*, o.last, surface + o.off - z AS pred FROM v JOIN o USING (well_id, cut) WHERE i >= cut),
r AS (SELECT well_id, cut, avg(pred - last) AS up, avg(tvt_input - last) AS truth, sqrt(avg((pred - tvt_input) * (pred - tvt_input))) AS rmse, sqrt(avg((last - tvt_input) * (last - tvt_input))) AS still FROM p GROUP BY ALL),
bt AS (SELECT well_id, avg(CASE WHEN sign(up) = sign(truth) THEN 1.0 ELSE 0 END) AS acc, quantile_cont(rmse, 0.9) AS r90, quantile_cont(abs(up - truth), 0.9) AS l90, avg(still - rmse) AS gain, count(*) AS cuts
  FROM r WHERE up IS NOT NULL AND truth IS NOT NULL GROUP BY well_id)"""


def structured(spark, sf_dir):
    h = wells(spark, sf_dir).withColumn("surface", F.when(F.col("row_idx") % 13 != 5, F.col("x") * 0.125 - F.col("y") * 0.0625))
    return K.structural_path(h)


def candidates(rows):
    h = S.anchors(rows, "tvt_input", "md")
    s = h.groupBy("well_id").agg(F.regr_slope("tvt_input", "md").alias("sl"))
    on = F.col("md") - F.col("last_md")
    last = F.col("last_tvt_input")
    items = {"hold": last, "line": last + F.col("sl") * on, "half": last + 0.5 * F.col("sl") * on, "up": last + 0.02 * on}
    fan = F.array(*[F.struct(F.lit(n).alias("item"), F.lit(i).alias("rank"), v.alias("pred")) for i, (n, v) in enumerate(items.items(), 1)])
    h = h.where("tvt_input is null").join(s, "well_id")
    return h.select("well_id", "row_idx", "struct", (0.55 * last + 0.45 * items["line"]).alias("base"), items["half"].alias("half"), F.explode(fan).alias("f")).select("*", "f.*").drop("f")


@query("c21_structural_choice", f"WITH {PARTS} SELECT well_id, item, round(cost, 5) + 0.0 AS cost, round(level, 6) AS level FROM b")
def c21(spark, sf_dir):
    return K.choose(candidates(structured(spark, sf_dir))).select("well_id", "item", (R(F.col("cost"), 5) + 0.0).alias("cost"), R(F.col("level")).alias("level"))


@query(
    "c21_structural_replays",
    f"WITH {PARTS}, {REPLAYS} SELECT well_id, round(acc, 6) AS bt_dir_acc, round(r90, 6) AS bt_rmse_p90, round(l90, 6) AS bt_level_abs_p90, round(gain, 6) + 0.0 AS bt_gain_mean, cuts FROM bt",
)
def c21_replays(spark, sf_dir):
    r = K.replays(structured(spark, sf_dir), least_seen=LEAST, least_hidden=LEAST)
    return r.select("well_id", *[(R(F.col(c)) + 0.0).alias(c) for c in ("bt_dir_acc", "bt_rmse_p90", "bt_level_abs_p90", "bt_gain_mean")], "cuts")


@query(
    "c21_structural_blend",
    f"""WITH {PARTS}, {REPLAYS}
SELECT c.well_id, c.row_idx, round(CASE WHEN acc >= 0.5 THEN 0.55 * half + 0.45 * coalesce(pred, half) ELSE half END, 6) AS level
FROM c JOIN b ON b.well_id = c.well_id AND b.item = c.item LEFT JOIN bt ON bt.well_id = c.well_id""",
)
def c21_blend(spark, sf_dir):
    rows = structured(spark, sf_dir)
    found = candidates(rows)
    chosen = found.join(K.choose(found).select("well_id", "item"), ["well_id", "item"])
    gate = K.replays(rows, least_seen=LEAST, least_hidden=LEAST).select("well_id", "bt_dir_acc")
    j = chosen.join(gate, "well_id", "left")
    return j.select("well_id", "row_idx", R(K.blended(F.col("half"), F.col("pred"), F.col("bt_dir_acc"))).alias("level"))
