"""Ranking candidates within groups: relative features, clusters, posteriors, gates, diverse choices, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataflow.operators.aggregates import average_rank


def relative_features(df: DataFrame, key: str, col: str) -> DataFrame:
    """<col>_z (null without spread), and its rank as a share of the group from below and from above, ties at their mean."""
    g = W.partitionBy(key)
    n = F.count(F.lit(1)).over(g)
    s = F.stddev_pop(col).over(g)
    up = average_rank(key, col)
    return df.withColumns({
        f"{col}_z": F.when(s > 0, (F.col(col) - F.avg(col).over(g)) / s),
        f"{col}_pct": up / n,
        f"{col}_pct_desc": (n + 1 - up) / n,
    })


def percentile_cost(key: str, col: str, tie: str) -> Column:
    """Place in the group from 0 to 1 by value, ties by another column."""
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    return (F.row_number().over(W.partitionBy(key).orderBy(col, tie)) - 1) / F.greatest(n - 1, F.lit(1))


def gap_clusters(df: DataFrame, key: str, col: str, gap: float, tie: str) -> DataFrame:
    """cluster: numbered from 0 along the sorted column; a step of more than ``gap`` begins a new one."""
    o = W.partitionBy(key).orderBy(col, tie)
    new = F.coalesce((F.col(col) - F.lag(col).over(o) > gap).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(o.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def top_k(df: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def cluster_table(df: DataFrame, key: str, evidence: list[str]) -> DataFrame:
    """Size and spread of each cluster's deltas, and mean, least and largest of every evidence column."""
    d = "delta"
    aggs = [
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("delta_mean"), F.stddev_pop(d).alias("delta_std"), F.min(d).alias("delta_min"),
        F.max(d).alias("delta_max"), (F.max(d) - F.min(d)).alias("delta_span"),
    ]
    for c in evidence:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.min(c).alias(f"{c}_low"), F.max(c).alias(f"{c}_high")]
    return df.groupBy(key, "cluster").agg(*aggs)


def softmax(key: str, col: str, tau: float) -> Column:
    g = W.partitionBy(key)
    e = F.exp((F.col(col) - F.max(col).over(g)) / tau)
    return e


def posterior(df: DataFrame, key: str, col: str, tau: float, name: str = "weight") -> DataFrame:
    """Soft-max of a score within its group."""
    out = df.withColumn("_e", softmax(key, col, tau))
    return out.withColumn(name, F.col("_e") / F.sum("_e").over(W.partitionBy(key))).drop("_e")


def confidence(df: DataFrame, key: str, col: str, tau: float) -> DataFrame:
    """By group: top probability, margin of the best over the second score, and entropy as a share of its maximum."""
    p = posterior(df, key, col, tau, "p").withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc(col), "cand")))
    n = F.count(F.lit(1))
    best, second = F.max(F.when(F.col("rank") == 1, F.col(col))), F.max(F.when(F.col("rank") == 2, F.col(col)))
    entropy = -F.sum(F.col("p") * F.log(F.greatest(F.col("p"), F.lit(1e-300))))
    return p.groupBy(key).agg(
        F.max("p").alias("top_prob"), F.coalesce(best - second, F.lit(0.0)).alias("margin"), F.when(n > 1, entropy / F.log(n)).otherwise(0.0).alias("entropy"), n.alias("n")
    )


def robust_z(df: DataFrame, key: str, col: str) -> DataFrame:
    """<col>_rz: distance from the group's median in scaled median deviations; 0 where these are 0."""
    mid = df.groupBy(key).agg(F.median(col).alias("_mid"))
    dev = df.join(mid, key).withColumn("_dev", F.abs(F.col(col) - F.col("_mid")))
    mad = dev.groupBy(key).agg((F.median("_dev") * 1.4826).alias("_mad"))
    z = F.when(F.col("_mad") > 1e-9, (F.col(col) - F.col("_mid")) / F.col("_mad")).otherwise(0.0)
    return dev.join(mad, key).withColumn(f"{col}_rz", z).drop("_mid", "_dev", "_mad")


def top_share(df: DataFrame, key: str, col: str, share: float) -> DataFrame:
    """in_top: whether a value's size is at or above the group's (1 - share) quantile of sizes."""
    q = df.groupBy(key).agg(F.percentile(F.abs(F.col(col)), F.lit(1.0 - share)).alias("_q"))
    return df.join(q, key).withColumn("in_top", F.abs(F.col(col)) >= F.col("_q")).drop("_q")


def jaccard_masks(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    both, either = F.count_if(F.col(a) & F.col(b)), F.count_if(F.col(a) | F.col(b))
    return df.groupBy(key).agg(F.when(either > 0, both / either).otherwise(0.0).alias("jaccard"))


def diverse(df: DataFrame, key: str, head: int, per_family: int, bin_width: float, total: int) -> DataFrame:
    """Candidates by priority: the best ones, then the best of each family, then the best two of each level bin, then the rest; ``total`` in all."""
    score = [F.desc("score"), F.asc("cand")]
    r = df.withColumn("_all", F.row_number().over(W.partitionBy(key).orderBy(*score)))
    r = r.withColumn("_bin", F.floor(F.col("delta") / bin_width))
    r = r.withColumn("_family", F.row_number().over(W.partitionBy(key, "family").orderBy(*score)))
    r = r.withColumn("_in_bin", F.row_number().over(W.partitionBy(key, "_bin").orderBy(*score)))
    tier = F.when(F.col("_all") <= head, 0).when(F.col("_family") <= per_family, 1).when(F.col("_in_bin") == 1, 2).when(F.col("_in_bin") == 2, 3).otherwise(4)
    r = r.withColumn("tier", tier)
    r = r.withColumn("kept_rank", F.row_number().over(W.partitionBy(key).orderBy("tier", "_all")))
    return r.where(F.col("kept_rank") <= total).drop("_all", "_bin", "_family", "_in_bin")


def ramped_move(base: Column, candidate: Column, row: Column, n: Column, alpha: float, clip: float) -> Column:
    """A move toward a candidate that grows along the rows with a time constant of max(80, 0.12 n), within a clip."""
    ramp = 1.0 - F.exp(-row / F.greatest(F.lit(80.0), 0.12 * n))
    return base + F.greatest(F.lit(-clip), F.least(F.lit(clip), alpha * ramp * (candidate - base)))


def gate(entropy: Column, move: Column, top: Column, entropy_max: float = 1.01, move_max: float = 30.0, top_min: float = 0.0) -> Column:
    return (entropy <= entropy_max) & (F.abs(move) <= move_max) & (top >= top_min)


def second_minimum(df: DataFrame, key: str, shift: str, cost: str, lo: float, hi: float) -> DataFrame:
    """By group the shift of least cost, and the one of least cost whose distance from it is within bounds."""
    best = df.groupBy(key).agg(F.min(F.struct(F.col(cost).alias("c"), F.col(shift).alias("s"))).alias("b"))
    j = df.join(best, key)
    apart = F.abs(F.col(shift) - F.col("b.s")).between(lo, hi)
    return j.groupBy(key).agg(
        F.first("b.s").alias("shift"), F.first("b.c").alias("cost"), F.min(F.when(apart, F.struct(F.col(cost).alias("c"), F.col(shift).alias("s")))).alias("o")
    ).select(key, "shift", "cost", F.col("o.s").alias("shift2"), F.col("o.c").alias("cost2"))


def mode_summary(df: DataFrame, key: str, level: str, weight: str, modes: int) -> DataFrame:
    """Weighted paths sorted by level and split into parts of equal mass: mean level and mass of each."""
    o = W.partitionBy(key).orderBy(level, "cand")
    before = F.coalesce(F.sum(weight).over(o.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum(weight).over(W.partitionBy(key))
    r = df.withColumn("mode", F.least(F.floor(before / total * modes), F.lit(modes - 1)).cast("int"))
    return r.groupBy(key, "mode").agg((F.sum(F.col(weight) * F.col(level)) / F.sum(weight)).alias("level"), F.sum(weight).alias("mass"))
