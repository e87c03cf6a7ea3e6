"""Aggregations over groups of a series: errors, robust fits, calibration, binning, weighted quantiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataflow.functions.columns import hash_unit
from strataflow.operators.order import running, tile


def rmse(err: Column) -> Column:
    return F.sqrt(F.avg(err * err))


def error_table(df: DataFrame, key: str = "well", y: str = "y", pred: str = "pred") -> DataFrame:
    """Sums by group from which every pooled error follows: n, sse, bias, rmse."""
    e = F.col(pred) - F.col(y)
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.avg(e).alias("bias"), rmse(e).alias("rmse"))


def diagnose(df: DataFrame, key: str = "well", y: str = "y", pred: str = "pred") -> DataFrame:
    """One row: rmse over rows, its split into level (group means) and swing (around them), and the mean rmse by group."""
    t = error_table(df, key, y, pred)
    n, s = F.sum("n"), F.sum("sse")
    inner = F.sum(F.col("sse") - F.col("n") * F.col("bias") * F.col("bias"))
    return t.agg(
        F.sqrt(s / n).alias("rmse"), F.sqrt(F.avg(F.col("bias") * F.col("bias"))).alias("level"), F.sqrt(F.greatest(inner, F.lit(0.0)) / n).alias("swing"),
        F.avg("rmse").alias("mean_per_group"), n.alias("rows"), F.count(F.lit(1)).alias("groups"),
    )


def tail_quantiles(df: DataFrame, col: str) -> DataFrame:
    """Quantiles of a column and the mean of what lies below the 0.95 quantile."""
    q = df.agg(*[F.percentile(col, F.lit(p)).alias(f"q{int(p * 100):02d}") for p in (0.05, 0.25, 0.5, 0.75, 0.95)], F.avg(col).alias("mean"))
    return df.join(F.broadcast(q)).where(F.col(col) <= F.col("q95")).groupBy("q05", "q25", "q50", "q75", "q95", "mean").agg(F.avg(col).alias("mean_below_q95"))


def robust_slope(y: str, x: str, when: Column | None = None) -> Column:
    """Slope of y on x, 0 with fewer than two rows or hardly any spread of x."""
    a, b = (F.col(y), F.col(x)) if when is None else (F.when(when, F.col(y)), F.when(when, F.col(x)))
    both = a.isNotNull() & b.isNotNull()
    fine = (F.count(F.when(both, 1)) >= 2) & (F.stddev_pop(F.when(both, b)) >= 1e-6)
    return F.when(fine, F.regr_slope(a, b)).otherwise(F.lit(0.0))


def trimmed_median(df: DataFrame, key: str, col: str, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """Median of the values of each group between two of its quantiles."""
    q = df.groupBy(key).agg(F.percentile(col, F.lit(lo)).alias("_lo"), F.percentile(col, F.lit(hi)).alias("_hi"))
    return df.join(q, key).where(F.col(col).between(F.col("_lo"), F.col("_hi"))).groupBy(key).agg(F.median(col).alias("trimmed_median"), F.count(F.lit(1)).alias("n_kept"))


def affine(df: DataFrame, key: str, observed: str, expected: str, min_pairs: int = 20) -> DataFrame:
    """Gain and offset by group that bring observed values to expected ones; 1 and 0 with too few pairs."""
    g = df.where(F.col(observed).isNotNull() & F.col(expected).isNotNull()).groupBy(key)
    t = g.agg(F.count(F.lit(1)).alias("n_pairs"), F.stddev_pop(observed).alias("_s"), F.regr_slope(expected, observed).alias("_a"), F.regr_intercept(expected, observed).alias("_b"))
    fine = (F.col("n_pairs") >= min_pairs) & (F.col("_s") > 1e-6)
    return t.select(key, "n_pairs", F.when(fine, F.col("_a")).otherwise(1.0).alias("gain"), F.when(fine, F.col("_b")).otherwise(0.0).alias("offset"))


def shrunk(gain: Column, offset: Column, by: float = 0.5) -> tuple[Column, Column]:
    """A calibration pulled part of the way to the identity."""
    return 1.0 + (gain - 1.0) * by, offset * by


def affine_robust(df: DataFrame, key: str, observed: str, expected: str, mad_k: float = 3.0, min_pairs: int = 20, clip: tuple[float, float] = (0.2, 5.0)) -> DataFrame:
    """``affine`` fitted again without the pairs that are ``mad_k`` scaled deviations from the median residual."""
    first = affine(df, key, observed, expected, min_pairs)
    r = df.join(first, key).withColumn("_r", F.col(expected) - F.col("gain") * F.col(observed) - F.col("offset"))
    mid = r.groupBy(key).agg(F.median("_r").alias("_m"))
    dev = r.join(mid, key).withColumn("_d", F.abs(F.col("_r") - F.col("_m")))
    mad = dev.groupBy(key).agg((F.median("_d") * 1.4826).alias("_mad"))
    kept = dev.join(mad, key).where(F.col("_d") <= mad_k * F.greatest(F.col("_mad"), F.lit(1e-6)))
    second = affine(kept.select(key, observed, expected), key, observed, expected, min_pairs)
    return second.withColumn("gain", F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), F.col("gain"))))


def noise_scale(df: DataFrame, key: str, residual: str, default: float = 30.0, lo: float = 10.0, hi: float = 60.0, min_pairs: int = 20) -> DataFrame:
    """Deviation of the residuals by group within bounds; the default with too few."""
    s = F.when(F.count(residual) >= min_pairs, F.greatest(F.lit(lo), F.least(F.lit(hi), F.stddev_pop(residual)))).otherwise(default)
    return df.groupBy(key).agg(s.alias("sigma"))


def bias_terms(df: DataFrame, key: str, order: str, bias: str) -> DataFrame:
    """Of known rows: median of all, median of the last 50, mean with weights that grow by exp(0.02) a row."""
    i = F.row_number().over(W.partitionBy(key).orderBy(order)) - 1
    back = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    r = df.withColumns({"_i": i, "_back": back, "_n": F.count(F.lit(1)).over(W.partitionBy(key))})
    w = F.exp(0.02 * (F.col("_i") - F.col("_n")))
    return r.groupBy(key).agg(
        F.median(bias).alias("bias_all"), F.median(F.when(F.col("_back") <= 50, F.col(bias))).alias("bias_tail"), (F.sum(w * F.col(bias)) / F.sum(w)).alias("bias_weighted")
    )


def average_rank(key: str, col: str) -> Column:
    """Rank with ties at their mean, from 1."""
    r = F.rank().over(W.partitionBy(key).orderBy(col))
    return r + (F.count(F.lit(1)).over(W.partitionBy(key, col)) - 1) / 2.0


def correlations(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Pearson and Spearman by group, 0 where a side does not vary."""
    r = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumns({"_ra": average_rank(key, a), "_rb": average_rank(key, b)})
    def safe(x: str, y: str) -> Column:
        sx, sy = F.stddev_pop(x), F.stddev_pop(y)  # corr() itself fails on a side that does not vary
        return F.when((sx > 1e-9) & (sy > 1e-9), F.try_divide(F.covar_pop(x, y), sx * sy)).otherwise(F.lit(0.0))
    return r.groupBy(key).agg(safe(a, b).alias("pearson"), safe("_ra", "_rb").alias("spearman"))


def huber(r: Column, scale: float) -> Column:
    a = F.abs(r) / scale
    return F.when(a <= 1.0, a * a / 2.0).otherwise(a - 0.5)


def weighted_quantile(df: DataFrame, key: str, value: str, weight: str, q: float) -> DataFrame:
    """The first value at which the running share of weight reaches q."""
    o = W.partitionBy(key).orderBy(value, weight)
    run = F.sum(weight).over(o.rowsBetween(W.unboundedPreceding, 0))
    r = df.withColumns({"_run": run, "_all": F.sum(weight).over(W.partitionBy(key))}).where(F.col("_run") >= q * F.col("_all"))
    return r.groupBy(key).agg(F.min(value).alias("weighted_quantile"))


def trimmed_weighted_mean(df: DataFrame, key: str, value: str, weight: str, lo: float, hi: float) -> DataFrame:
    """Weighted mean of the values whose running share of weight lies between two bounds."""
    o = W.partitionBy(key).orderBy(value, weight)
    run = F.sum(weight).over(o.rowsBetween(W.unboundedPreceding, 0)) / F.sum(weight).over(W.partitionBy(key))
    r = df.withColumn("_run", run).where(F.col("_run").between(lo, hi))
    return r.groupBy(key).agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias("trimmed_mean"))


def bins(df: DataFrame, size: int, key: str = "well_id", order: str = "row_idx", value: str = "gr", x: str = "md") -> DataFrame:
    """Series cut into bins of ``size`` rows: mean, deviation, count, rate, extremes, last minus first and slope of the values there are."""
    v = F.col(value)
    at = F.when(v.isNotNull(), F.col(order))
    return df.groupBy(key, F.floor(F.col(order) / size).cast("long").alias("bin")).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"), (F.count(value) / float(size)).alias("rate"), F.min(value).alias("low"),
        F.max(value).alias("high"), (F.max_by(value, at) - F.min_by(value, at)).alias("change"), F.regr_slope(v, F.col(x)).alias("slope"),
    )


def quadratic(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """a + b x + c x^2 by group with its rmse, from moments; null with fewer than three rows."""
    rows = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    t, v = F.col(x), F.col(y)
    m = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("s0"), F.sum(t).alias("su"), F.sum(t * t).alias("sv"), F.sum(t * t).alias("suu"), F.sum(t * t * t).alias("suv"), F.sum(t * t * t * t).alias("svv"),
        F.sum(v).alias("sz"), F.sum(t * v).alias("suz"), F.sum(t * t * v).alias("svz"), F.sum(v * v).alias("szz"),
    )
    from strataflow.operators.spatial import cramer3

    a, b, c = cramer3()
    m = m.withColumns({"a": F.when(F.col("s0") >= 3, a), "b": F.when(F.col("s0") >= 3, b), "c": F.when(F.col("s0") >= 3, c)})
    sse = F.col("szz") - F.col("a") * F.col("sz") - F.col("b") * F.col("suz") - F.col("c") * F.col("svz")
    return m.select(*keys, "a", "b", "c", F.sqrt(F.greatest(sse, F.lit(0.0)) / F.col("s0")).alias("rmse"))


def log_sum_exp(df: DataFrame, key: str, value: str, tau: float) -> DataFrame:
    """tau * log(sum(exp(value / tau))) by group, steady for large values."""
    top = F.max(value).over(W.partitionBy(key))
    return df.withColumn("_e", F.exp((F.col(value) - top) / tau)).withColumn("_top", top).groupBy(key).agg((F.max("_top") + tau * F.log(F.sum("_e"))).alias("log_sum_exp"))


def weighted_stats(df: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    w, v = F.col(weight), F.col(value)
    mean = F.sum(w * v) / F.sum(w)
    return df.groupBy(key).agg(mean.alias("w_mean"), F.sqrt(F.greatest(F.sum(w * v * v) / F.sum(w) - mean * mean, F.lit(0.0))).alias("w_std"), (F.sum(w * F.abs(v)) / F.sum(w)).alias("w_abs"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by rank sums over distinct scores, and average precision; one row."""
    t = df.groupBy(score).agg(F.sum(F.col(label)).alias("p"), F.count(F.lit(1)).alias("n"))
    t = running(t, [F.desc(score)], {"_p": F.col("p"), "_n": F.col("n")})
    t = t.withColumns({"tp": F.col("_p") + F.col("p"), "seen": F.col("_n") + F.col("n")})
    t = t.withColumns({"fp": F.col("seen") - F.col("tp"), "neg": F.col("n") - F.col("p")})
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("p") / 2.0))
    return t.agg((area / (F.sum("p") * F.sum("neg"))).alias("auc"), (F.sum(F.col("p") * F.col("tp") / F.col("seen")) / F.sum("p")).alias("average_precision"))


def deciles(df: DataFrame, score: str, label: str, parts: int = 10) -> DataFrame:
    """Rows, mean score and rate of the label by tenth of the score."""
    r = tile(df, [F.col(score), F.col("id")], parts, "decile")
    return r.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(label).alias("rate"))


def subsamples(df: DataFrame, key: str, draws: int, size: int) -> DataFrame:
    """``df`` (a row for each key) drawn ``draws`` times: ``draw`` and its rows, ``size`` places each, of which equal ones count once.

    Places are hashed, not rows, so the work is that of the draws however many keys there are.
    """
    total = df.count()
    placed = running(df, [F.col(key)], {"_place": F.lit(1)})
    ids = df.sparkSession.range(draws * size).select(F.floor(F.col("id") / size).alias("draw"), (F.col("id") % size).alias("_j"))
    picks = ids.select("draw", F.floor(hash_unit("draw", "_j") * F.lit(total)).cast("long").alias("_place")).distinct()
    return picks.join(placed, "_place").drop("_place")


def tukey(r: Column, c: float) -> Column:
    """Tukey's biweight of a residual."""
    u = r / c
    return F.when(F.abs(u) < 1.0, (1.0 - u * u) * (1.0 - u * u)).otherwise(F.lit(0.0))


TWO_PI = 2.0 * math.pi
