"""Queries of formation contacts and of work in shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.operators import contacts as K
from strataflow.operators import sequence as S
from strataflow.operators import shards as D
from strataflow.plans.proxies import CURVES, GEOLOGY, TOPS, WELLS, geology, tops, wells
from strataflow.plans.registry import query
from strataflow.sources import wells as io

R = lambda c, n=6: F.round(c, n)


@query(
    "c4_contact_candidates",
    f"""WITH {WELLS}, {CURVES}, {GEOLOGY}, {TOPS},
a AS (SELECT *, arg_max(tvt_input, row_idx) FILTER (WHERE tvt_input IS NOT NULL) OVER (PARTITION BY well_id) + 0.125 * row_idx AS anchor FROM h),
j AS (SELECT a.*, formation, top FROM a JOIN tops USING (well_id, row_idx)),
f AS (SELECT well_id, curve_id, formation, count(CASE WHEN tvt_input IS NOT NULL AND top IS NOT NULL THEN 1 END) AS known,
  count(CASE WHEN tvt_input IS NULL AND top IS NOT NULL THEN 1 END) AS tops, count(CASE WHEN tvt_input IS NULL THEN 1 END) AS hidden,
  median(CASE WHEN top IS NOT NULL THEN tvt_input - (top - z) END) AS o, avg(CASE WHEN tvt_input IS NULL THEN top - z END) AS m,
  avg(CASE WHEN tvt_input IS NULL THEN anchor END) AS am FROM j GROUP BY ALL),
k AS (SELECT f.*, CASE WHEN EXISTS (SELECT 1 FROM geo g WHERE g.curve_id = f.curve_id AND g.formation = f.formation)
  THEN 'formation_contact:' ELSE 'formation_contact_prior:' END || formation AS candidate
  FROM f WHERE known >= 8 AND tops >= greatest(4, hidden // 5))
SELECT well_id, row_idx, candidate, round(o + (top - z), 6) AS tvt, round(o + m + anchor - am, 6) AS centred
FROM j JOIN k USING (well_id, formation) WHERE tvt_input IS NULL""",
)
def c4(spark, sf_dir):
    h = S.anchors(wells(spark, sf_dir), "tvt_input").withColumn("anchor", F.col("last_tvt_input") + 0.125 * F.col("row_idx"))
    found = K.candidates(h, tops(spark, sf_dir), geology(spark, sf_dir), "anchor")
    return found.select("well_id", "row_idx", "candidate", R(F.col("tvt")).alias("tvt"), R(F.col("centred")).alias("centred"))


@query(
    "c4_formation_crossings",
    f"""WITH {WELLS}, {CURVES}, {GEOLOGY}, {TOPS},
d AS (SELECT well_id, curve_id, formation, row_idx, md, tvt, z - top AS up FROM h JOIN tops USING (well_id, row_idx) WHERE top IS NOT NULL),
l AS (SELECT *, lag(md) OVER o AS md0, lag(tvt) OVER o AS tvt0, lag(up) OVER o AS up0 FROM d WINDOW o AS (PARTITION BY well_id, formation ORDER BY row_idx)),
x AS (SELECT well_id, curve_id, formation, row_idx, md0 + up0 / (up0 - up) * (md - md0) AS md, tvt0 + up0 / (up0 - up) * (tvt - tvt0) AS tvt,
  CASE WHEN up > 0 THEN 'up' ELSE 'down' END AS direction FROM l WHERE (up > 0) <> (up0 > 0)),
t AS (SELECT curve_id, formation, min(tvt) AS lo FROM geo GROUP BY ALL),
i AS (SELECT *, lead(lo) OVER (PARTITION BY curve_id ORDER BY lo, formation) AS hi FROM t)
SELECT well_id, x.formation, row_idx, round(md, 6) AS md, round(tvt, 6) AS tvt, direction, i.formation AS inside
FROM x LEFT JOIN i ON i.curve_id = x.curve_id AND tvt >= lo AND (hi IS NULL OR tvt < hi)""",
)
def c4_crossings(spark, sf_dir):
    found = K.inside(K.crossings(wells(spark, sf_dir), tops(spark, sf_dir)), geology(spark, sf_dir))
    return found.select("well_id", "formation", "row_idx", R(F.col("md")).alias("md"), R(F.col("tvt")).alias("tvt"), "direction", "inside")


def extrapolated(rows):
    """Hidden levels on the line of the known ones."""
    from strataflow.operators.aggregates import robust_slope

    h = S.anchors(rows, "tvt_input", "md").where("last_md is not null")
    s = h.groupBy("well_id").agg(robust_slope("tvt_input", "md", F.col("tvt_input").isNotNull()).alias("s"))
    v = F.col("last_tvt_input") + F.col("s") * (F.col("md") - F.col("last_md"))
    return h.join(s, "well_id").select("well_id", "row_idx", F.when(F.col("tvt_input").isNull(), v).otherwise(F.col("tvt_input")).alias("v"))


@query(
    "s7_resumed_shards",
    f"""WITH {WELLS}, k AS (SELECT well_id, arg_max(tvt_input, row_idx) AS l, arg_max(md, row_idx) AS m, regr_slope(tvt_input, md) AS s FROM h WHERE tvt_input IS NOT NULL GROUP BY well_id)
SELECT h.well_id, row_idx, round(coalesce(tvt_input, l + s * (md - m)), 6) AS v FROM h JOIN k USING (well_id)""",
)
def s7_resumed(spark, sf_dir):
    """A run that ends after one of its waves, the run that goes on from its ledger, and the merge of all shards."""
    rows = wells(spark, sf_dir)
    root = io.folder(spark, "shards")
    D.run(rows, "well_id", extrapolated, root, shards=8, wave=4, waves=1, method="line")
    D.run(rows, "well_id", extrapolated, root, shards=8, wave=4, method="line")
    merged = D.merge(rows, "well_id", root, shards=8, unique=["well_id", "row_idx"], method="line")
    return merged.select("well_id", "row_idx", R(F.col("v")).alias("v"))
