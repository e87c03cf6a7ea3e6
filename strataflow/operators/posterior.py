"""Distributions over levels and what is decided from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataflow.operators.ranking import posterior


def trusted_level(df: DataFrame, key: str, score: str, delta: str, tau: float, entropy_max: float = 0.9, least: float = 1.0, agree: float = 0.75, clip: float = 4.0, gain: float = 0.9) -> DataFrame:
    """move: the posterior mean delta, damped and clipped, where entropy, size and agreement of signs allow it; else 0."""
    p = posterior(df, key, score, tau, "_p")
    n, w = F.count(F.lit(1)), F.col("_p")
    entropy = F.when(n > 1, -F.sum(w * F.log(F.greatest(w, F.lit(1e-300)))) / F.log(n)).otherwise(0.0)
    g = p.groupBy(key).agg(F.sum(w * F.col(delta)).alias("mean"), entropy.alias("entropy"), F.sum(F.when(F.col(delta) > 0, w).otherwise(0.0)).alias("up"))
    ok = (F.col("entropy") <= entropy_max) & (F.abs("mean") >= least) & (F.greatest(F.col("up"), 1 - F.col("up")) >= agree)
    return g.withColumn("move", F.when(ok, gain * F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col("mean")))).otherwise(0.0))


def soft_targets(df: DataFrame, value: str, lo: int, hi: int, step: float, sigma: float, reach: float) -> DataFrame:
    """A row for each level within ``reach`` of the value with its Gaussian weight; weights sum to 1 over all levels."""
    levels = F.sequence(F.lit(0), F.lit(int((hi - lo) / step)))
    rows = df.withColumn("level", F.explode(F.transform(levels, lambda i: F.lit(float(lo)) + i * step)))
    d = F.col("level") - F.col(value)
    rows = rows.withColumn("_e", F.exp(-d * d / (2.0 * sigma * sigma)))
    rows = rows.withColumn("p", F.col("_e") / F.sum("_e").over(W.partitionBy("well_id", "row_idx")))
    return rows.where(F.abs(F.col("level") - F.col(value)) <= reach).drop("_e")
