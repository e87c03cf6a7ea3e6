"""Log series made of the driver's tables: wells are users, rows are their events in order.

All coordinates are integers divided by ten, so that any engine computes the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataflow.tables import table


def wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """well_id, row_idx, n, md, x, y, z, gr (with gaps), tvt, tvt_input (known in the first six tenths), curve_id."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    o = W.partitionBy("user_id").orderBy("ts", "event_id")
    run = lambda a, m, c: F.sum((F.col("event_id") * a) % m - c).over(o.rowsBetween(W.unboundedPreceding, 0)).cast("double") / 10.0
    h = e.select(
        F.col("user_id").alias("well_id"),
        "event_id",
        (F.row_number().over(o) - 1).cast("long").alias("row_idx"),
        F.count(F.lit(1)).over(W.partitionBy("user_id")).alias("n"),
        run(7919, 201, 90).alias("x"),
        run(104729, 151, 70).alias("y"),
        (-run(31, 11, 0)).alias("z"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("gr"),
        (run(17, 9, 4) + 100.0).alias("tvt"),
        (F.col("user_id") % 5).alias("curve_id"),
    )
    h = h.withColumn("md", (F.col("row_idx") * 10 + F.col("event_id") % 3).cast("double"))
    return h.withColumn("tvt_input", F.when(F.col("row_idx") * 10 < F.col("n") * 6, F.col("tvt"))).drop("event_id")


WELLS = """e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_idx, count(*) OVER (PARTITION BY user_id) AS n FROM events),
h0 AS (SELECT user_id AS well_id, row_idx, n, CAST(row_idx * 10 + event_id % 3 AS DOUBLE) AS md,
 CAST(sum((event_id * 7919) % 201 - 90) OVER o AS DOUBLE) / 10.0 AS x, CAST(sum((event_id * 104729) % 151 - 70) OVER o AS DOUBLE) / 10.0 AS y,
 -(CAST(sum((event_id * 31) % 11) OVER o AS DOUBLE) / 10.0) AS z, CASE WHEN event_id % 7 <> 0 THEN value END AS gr,
 CAST(sum((event_id * 17) % 9 - 4) OVER o AS DOUBLE) / 10.0 + 100.0 AS tvt, user_id % 5 AS curve_id
 FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
h AS (SELECT *, CASE WHEN row_idx * 10 < n * 6 THEN tvt END AS tvt_input FROM h0)"""


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """curve_id, tvt, gr: five reference curves with a point for every part size."""
    p = table(spark, sf_dir, "part")
    return p.groupBy((F.col("p_partkey") % 5).alias("curve_id"), (F.col("p_size") + 75).cast("double").alias("tvt")).agg(
        F.min("p_retailprice").alias("gr")
    )


CURVES = "c AS (SELECT p_partkey % 5 AS curve_id, CAST(p_size + 75 AS DOUBLE) AS tvt, min(p_retailprice) AS gr FROM part GROUP BY ALL)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spatial cloud: well_id, point_id, x, y, value, all rows of all wells."""
    h = wells(spark, sf_dir)
    return h.select("well_id", (F.col("well_id") * 100000 + F.col("row_idx")).alias("point_id"), "x", "y", (F.col("tvt") + F.col("z")).alias("value"))


POINTS = "pts AS (SELECT well_id, well_id * 100000 + row_idx AS point_id, x, y, tvt + z AS value FROM h)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates: grp, cand, family, score, delta."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("grp"),
        F.col("o_orderkey").alias("cand"),
        F.col("o_orderpriority").alias("family"),
        ((F.col("o_orderkey") * 37) % 1000).cast("double").alias("score"),
        (((F.col("o_orderkey") * 53) % 801 - 400).cast("double") / 10.0).alias("delta"),
    )


SCORED = """k AS (SELECT o_custkey AS grp, o_orderkey AS cand, o_orderpriority AS family, CAST((o_orderkey * 37) % 1000 AS DOUBLE) AS score,
 CAST((o_orderkey * 53) % 801 - 400 AS DOUBLE) / 10.0 AS delta FROM orders)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """well, row, y, pred, fold: lines of a supplier with a price and a guess."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("well"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"),
        F.col("l_extendedprice").alias("y"),
        (F.col("l_quantity") * 1500.0).alias("pred"),
        (F.col("l_suppkey") % 5).alias("fold"),
    )


PREDICTIONS = """p AS (SELECT l_suppkey AS well, l_orderkey * 10 + l_linenumber AS row, l_extendedprice AS y, l_quantity * 1500.0 AS pred, l_suppkey % 5 AS fold FROM lineitem)"""


def geology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """curve_id, tvt, formation: the curves' points in five formations of ten levels."""
    return curves(spark, sf_dir).select("curve_id", "tvt", F.concat(F.lit("F"), F.floor((F.col("tvt") - 76) / 10).cast("string")).alias("formation"))


GEOLOGY = "geo AS (SELECT curve_id, tvt, 'F' || CAST(floor((tvt - 76) / 10) AS BIGINT) AS formation FROM c)"


def tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """well_id, row_idx, formation, top: six tilted surfaces at each row with gaps; the last one is on no curve, the fifth mostly missing."""
    h = wells(spark, sf_dir).select("well_id", "row_idx", "n", "x", "y").withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(5))))
    top = -(F.col("n") * 5) / 20.0 + F.col("x") * 0.125 - F.col("y") * 0.0625 - F.col("f") * 10 + (F.col("row_idx") * 7 + F.col("f")) % 5
    gap = ((F.col("row_idx") + F.col("f") * 3 + F.col("well_id")) % 11 == 0) | ((F.col("f") == 4) & (F.col("row_idx") % 10 != 3))
    return h.select("well_id", "row_idx", F.concat(F.lit("F"), F.col("f").cast("string")).alias("formation"), F.when(~gap, top).alias("top"))


TOPS = """tops AS (SELECT well_id, row_idx, 'F' || f AS formation, CASE WHEN (row_idx + f * 3 + well_id) % 11 <> 0 AND (f <> 4 OR row_idx % 10 = 3) THEN
 -(n * 5) / 20.0 + x * 0.125 - y * 0.0625 - f * 10 + (row_idx * 7 + f) % 5 END AS top FROM h, (SELECT unnest(range(0, 6)) AS f))"""
