"""Folds by group, and keeping what is learned apart from what is scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataflow.functions.columns import hash_unit
from strataflow.operators.order import running


def modulo_folds(df: DataFrame, key: str, k: int) -> DataFrame:
    """(key, fold) by the key's remainder."""
    return df.select(key).distinct().withColumn("fold", (F.col(key) % k).cast("int"))


def balanced_folds(df: DataFrame, key: str, k: int) -> DataFrame:
    """(key, fold): groups by falling size, dealt back and forth so that the folds' rows even out."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    sizes = running(sizes, [F.desc("n"), F.col(key)], {"r": F.lit(1)})
    turn, place = F.floor(F.col("r") / k) % 2, F.col("r") % k
    return sizes.select(key, "n", F.when(turn == 0, place).otherwise(k - 1 - place).cast("int").alias("fold"))


def stratified_folds(df: DataFrame, key: str, stratum: str, k: int, seed: int = 0) -> DataFrame:
    """(key, fold): within each stratum, groups in the order of a hash, dealt in turn."""
    d = df.select(key, stratum).distinct()
    h = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string")).cast("binary"))
    return d.withColumn("fold", ((F.row_number().over(W.partitionBy(stratum).orderBy(h, key)) - 1) % k).cast("int"))


def outside_fold(df: DataFrame, folds: DataFrame, key: str, fold: int) -> DataFrame:
    """Rows of groups outside a fold: all that may be learned from when it is scored."""
    return df.join(folds.where(F.col("fold") == fold).select(key), key, "left_anti")


def inside_fold(df: DataFrame, folds: DataFrame, key: str, fold: int) -> DataFrame:
    return df.join(folds.where(F.col("fold") == fold).select(key), key, "left_semi")


def out_of_fold_means(df: DataFrame, key: str, fold: str, by: str, value: str) -> DataFrame:
    """Each row with the mean of ``value`` of its ``by`` level over all other folds; the mean of all other folds where that is empty."""
    level = df.groupBy(by, fold).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    every = df.groupBy(fold).agg(F.sum(value).alias("_fs"), F.count(value).alias("_fn"))
    total = W.partitionBy(by)
    level = level.withColumns({"_os": F.sum("_s").over(total) - F.col("_s"), "_on": F.sum("_n").over(total) - F.col("_n")})
    all_rows = W.partitionBy()
    every = every.withColumns({"_as": F.sum("_fs").over(all_rows) - F.col("_fs"), "_an": F.sum("_fn").over(all_rows) - F.col("_fn")})
    j = df.join(level.select(by, fold, "_os", "_on"), [by, fold]).join(every.select(fold, "_as", "_an"), fold)
    fill = F.when(F.col("_an") > 0, F.col("_as") / F.col("_an"))
    return j.withColumn("oof_mean", F.when(F.col("_on") > 0, F.col("_os") / F.col("_on")).otherwise(fill)).drop("_os", "_on", "_as", "_an")


def blend_sweep(df: DataFrame, a: str, b: str, y: str, steps: int = 10) -> DataFrame:
    """rmse of w * a + (1 - w) * b for weights from 0 to 1, from one pass of moments."""
    da, db = F.col(a) - F.col(y), F.col(b) - F.col(y)
    m = df.agg(F.avg(da * da).alias("aa"), F.avg(da * db).alias("ab"), F.avg(db * db).alias("bb"))
    w = F.col("step") / float(steps)
    m = m.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    return m.select("step", w.alias("weight"), F.sqrt(F.greatest(w * w * F.col("aa") + 2 * w * (1 - w) * F.col("ab") + (1 - w) * (1 - w) * F.col("bb"), F.lit(0.0))).alias("rmse"))


def drawn_specs(draws: DataFrame, keys: list[str], draw: str, space: dict[str, tuple[float, ...]]) -> DataFrame:
    """Specifications drawn by hash: for each draw of a key one value of each parameter; those that repeat within a key are one, by the first draw."""
    pick = lambda name, v: F.element_at(F.array(*[F.lit(float(x)) for x in v]), (F.floor(hash_unit(*keys, draw, F.lit(name)) * len(v)) + 1).cast("int"))
    specs = draws.select(*keys, draw, *[pick(n, v).alias(n) for n, v in space.items()])
    return specs.groupBy(*keys, *space).agg(F.min(draw).alias(draw)).select(*keys, draw, *space)
