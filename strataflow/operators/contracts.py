"""Checks that run with the query: a broken contract fails the job when its rows are computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with one row for each key; fails on a second one."""
    others = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in others])
    ok = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("repeated key "), *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])).cast("boolean"))
    return g.where(ok).drop("_n")


def sidecar(base: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with the columns of a side table of at most one row for each key."""
    return base.join(_unique(side, keys), keys, "left")


def many_to_one(base: DataFrame, dimension: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that checks that the dimension has no key twice."""
    return base.join(_unique(dimension, keys), keys)


def align(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Two runs by key, side by side, with whether both have it."""
    a, b = left.select(F.col(key).alias("_k1"), F.col(value).alias("a")), right.select(F.col(key).alias("_k2"), F.col(value).alias("b"))
    j = a.join(b, F.col("_k1") == F.col("_k2"), "full")
    return j.select(F.coalesce("_k1", "_k2").alias(key), "a", "b", (F.col("_k1").isNotNull() & F.col("_k2").isNotNull()).alias("in_both"))


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """``df``, failing on the first row that misses a condition."""
    return df.where(F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def forbid(df: DataFrame, names: set[str]) -> DataFrame:
    """``df``, unless it has a column that scoring may not see."""
    seen = names & set(df.columns)
    if seen:
        raise ValueError(f"columns {sorted(seen)} must not be scored")
    return df


def coverage(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """Keys that are missing or not expected, with which of both."""
    a, b = expected.select(key).distinct(), got.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("problem", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("problem", F.lit("unexpected")))
