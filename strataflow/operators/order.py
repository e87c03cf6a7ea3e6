"""Running sums and ranks in a total order of all rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataflow.operators.spatial import cut


def running(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """``df`` with, by name, the sum of a value over all rows before it in ``order``, which must be total.

    Rows are dealt by range; each range sums its own rows, and the sums of the ranges before it are added. Only these,
    one row for each range, meet in one place.
    """
    names = list(values)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.withColumns({f"_v_{n}": v for n, v in values.items()}).repartitionByRange(parts, *order)
    ranges = cut(ranges.withColumn("_range", F.spark_partition_id()))
    sums = ranges.groupBy("_range").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_range", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in names])
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = ranges.join(F.broadcast(sums), "_range")
    out = out.withColumns({n: F.col(f"_b_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in names})
    return out.select(*df.columns, *names)


def tile(df: DataFrame, order: list[Column], parts: int, name: str) -> DataFrame:
    """``df`` with ``name``: which of ``parts`` equal parts of the order a row is in, from 1; the first parts have one row more."""
    ranked = running(df, order, {"_before": F.lit(1)})
    # one row: how many there are
    ranked = ranked.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_rows"))))
    size, more = F.floor(F.col("_rows") / parts), F.col("_rows") % parts
    late = F.floor((F.col("_before") - (size + 1) * more) / F.greatest(size, F.lit(1))) + more + 1
    place = F.when(F.col("_before") < (size + 1) * more, F.floor(F.col("_before") / (size + 1)) + 1).otherwise(late)
    return ranked.withColumn(name, place.cast("int")).drop("_before", "_rows")
