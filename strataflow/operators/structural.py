"""A candidate path by its likeness to a structural path, and when to trust the choice.

A structural path is a surface predicted at each row, less z, at the mean distance of the known rows. Candidates are
compared with it and with a base path in robust units within the well; the one of the least cost is blended in where
replays of the known rows say that the surface tells the right direction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Weights of the distances to the structural path, its level and shape, to the base path and of the rank; of the choice
#: in the blend; share of right directions that opens the gate; parts of the known rows where replays begin.
COSTS = {"path_rmse": 1.0, "struct_abs": 0.0, "shape_rmse": 0.5, "base_abs": 0.5}
RANK_COST, BLEND, DIRECTION = 0.0, 0.45, 0.5
CUTS = (0.45, 0.60, 0.75, 0.85)


def structural_path(rows: DataFrame, surface: str = "surface") -> DataFrame:
    """``rows`` (well_id, z, tvt_input, a surface) with ``struct``; null where the surface is or where no known row has one."""
    known = F.when(F.col("tvt_input").isNotNull(), F.col("tvt_input") + F.col("z") - F.col(surface))
    offset = rows.groupBy("well_id").agg(F.avg(known).alias("_offset"))
    return rows.join(offset, "well_id").withColumn("struct", F.col(surface) + F.col("_offset") - F.col("z")).drop("_offset")


def replays(rows: DataFrame, surface: str = "surface", least_seen: int = 80, least_hidden: int = 80) -> DataFrame:
    """By well, over the cuts that leave enough rows: bt_dir_acc, bt_rmse_p90, bt_level_abs_p90, bt_gain_mean, cuts.

    Each replay sees the known rows before its cut and predicts the ones after it from the surface; a path that
    stays at the last level is what it gains over.
    """
    o = W.partitionBy("well_id").orderBy("row_idx")
    k = rows.where("tvt_input is not null").withColumns({"i": F.row_number().over(o) - 1, "ps": F.count(F.lit(1)).over(W.partitionBy("well_id"))})
    cuts = F.array_distinct(F.array(*[F.round(F.col("ps") * c).cast("int") for c in CUTS]))
    k = k.withColumn("cut", F.explode(cuts)).where((F.col("cut") >= least_seen) & (F.col("ps") - F.col("cut") >= least_hidden))
    seen, late = F.col("i") < F.col("cut"), F.col("i") >= F.col("cut")
    off = k.groupBy("well_id", "cut").agg(
        F.avg(F.when(seen, F.col("tvt_input") + F.col("z") - F.col(surface))).alias("offset"), F.max(F.when(F.col("i") == F.col("cut") - 1, F.col("tvt_input"))).alias("last")
    )
    k = k.where(late).join(off, ["well_id", "cut"]).withColumn("pred", F.col(surface) + F.col("offset") - F.col("z"))
    sq = lambda c: F.sqrt(F.avg(c * c))
    r = k.groupBy("well_id", "cut").agg(
        F.avg(F.col("pred") - F.col("last")).alias("up"), F.avg(F.col("tvt_input") - F.col("last")).alias("truth"),
        sq(F.col("pred") - F.col("tvt_input")).alias("rmse"), sq(F.col("last") - F.col("tvt_input")).alias("still"),
    ).where("up is not null and truth is not null")
    p90 = lambda c: F.percentile(c, F.lit(0.9))
    right = (F.signum("up") == F.signum("truth")).cast("double")
    return r.groupBy("well_id").agg(
        F.avg(right).alias("bt_dir_acc"), p90(F.col("rmse")).alias("bt_rmse_p90"), p90(F.abs(F.col("up") - F.col("truth"))).alias("bt_level_abs_p90"),
        F.avg(F.col("still") - F.col("rmse")).alias("bt_gain_mean"), F.count(F.lit(1)).alias("cuts"),
    )


def distances(candidates: DataFrame) -> DataFrame:
    """By well and item, from (well_id, item, rank, pred, base, struct): path_rmse, shape_rmse, struct_abs, base_abs, level."""
    d = F.when(F.col("struct").isNotNull(), F.col("pred") - F.col("struct"))
    m = candidates.groupBy("well_id", "item", "rank").agg(
        F.avg("pred").alias("level"), F.avg("struct").alias("_s"), F.avg(d).alias("_d"), F.avg(d * d).alias("_dd"), F.avg(F.abs(F.col("pred") - F.col("base"))).alias("base_abs")
    )
    apart = F.col("level") - F.col("_s")
    shape = F.sqrt(F.greatest(F.col("_dd") - 2 * apart * F.col("_d") + apart * apart, F.lit(0.0)))
    return m.select("well_id", "item", "rank", "level", "base_abs", F.sqrt("_dd").alias("path_rmse"), F.abs(apart).alias("struct_abs"), shape.alias("shape_rmse"))


def _robust(df: DataFrame, col: str) -> DataFrame:
    """``_z_<col>``: distance from the well's median in scaled median deviations, or in deviations where these are 0; 1e6 for null."""
    g = W.partitionBy("well_id")
    df = df.withColumn("_mid", F.median(col).over(g)).withColumn("_mad", F.median(F.abs(F.col(col) - F.col("_mid"))).over(g))
    scale = F.when(F.col("_mad") > 1e-9, 1.4826 * F.col("_mad")).otherwise(F.stddev_pop(col).over(g) + 1e-6)
    return df.withColumn(f"_z_{col}", F.coalesce((F.col(col) - F.col("_mid")) / scale, F.lit(1e6))).drop("_mid", "_mad")


def choose(candidates: DataFrame) -> DataFrame:
    """(well_id, item, cost, level) of the least cost of each well; ties go to the lower rank, then to the name.

    Wells without any structural value choose nothing.
    """
    d = distances(candidates).where("path_rmse is not null")
    for c in COSTS:
        d = _robust(d, c)
    cost = sum((F.col(f"_z_{c}") * w for c, w in COSTS.items()), F.col("rank") / 40.0 * RANK_COST)
    best = F.min_by(F.struct("item", "cost", "level"), F.struct(F.round("cost", 9), "rank", "item"))
    return d.withColumn("cost", cost).groupBy("well_id").agg(best.alias("b")).select("well_id", "b.*")


def blended(base: Column, pred: Column, direction: Column) -> Column:
    """The base path, with a share of the chosen one where enough replays had the right direction."""
    return F.when(direction >= DIRECTION, (1 - BLEND) * base + BLEND * F.coalesce(pred, base)).otherwise(base)
