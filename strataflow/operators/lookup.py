"""Looking up reference curves at arbitrary places: interpolation, nearest point, integrals.

A curve is a table (curve key, place, value). Queries and curve points are merged into one stream per key and
sorted, and each query takes the last point before it and the first after it: one shuffle and one sort
whatever the number of points, no range join and no broadcast. A hot curve key is dealt over ``salts`` tasks,
to each of which the curve is copied, since curves are small beside their queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _neighbours(queries: DataFrame, curve: DataFrame, key: str, at: str, place: str, value: str, salts: int) -> DataFrame:
    """``queries`` with _b and _a: the points (t, v) at or before and at or after each place."""
    unique = curve.where(F.col(place).isNotNull()).groupBy(key, place).agg(F.avg(value).alias(value))
    point = F.struct(F.col(place).alias("t"), F.col(value).alias("v"))
    left = queries.select(key, F.col(at).alias("_t"), F.struct(*[F.col(f"`{c}`") for c in queries.columns]).alias("_q"))
    left = left.withColumn("_s", F.pmod(F.xxhash64("_q"), F.lit(salts)).cast("int"))
    right = unique.select(key, F.col(place).alias("_t"), point.alias("_p")).withColumn("_s", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    both = left.withColumn("_p", F.lit(None).cast(right.schema["_p"].dataType)).unionByName(right.withColumn("_q", F.lit(None).cast(left.schema["_q"].dataType)))
    w = W.partitionBy(key, "_s").orderBy(F.col("_t"), F.col("_p").isNull())
    v = W.partitionBy(key, "_s").orderBy(F.col("_t").desc(), F.col("_p").isNull())
    both = both.withColumn("_b", F.last("_p", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    both = both.withColumn("_a", F.last("_p", ignorenulls=True).over(v.rowsBetween(W.unboundedPreceding, 0)))
    return both.where(F.col("_q").isNotNull()).select("_q.*", F.when(F.col("_t").isNotNull(), F.col("_b")).alias("_b"), F.when(F.col("_t").isNotNull(), F.col("_a")).alias("_a"))


def interpolate(queries: DataFrame, curve: DataFrame, key: str, at: str, place: str = "tvt", value: str = "gr", name: str = "looked_up", clamp: bool = True, salts: int = 1) -> DataFrame:
    """Linear interpolation; outside the curve the end value (``clamp``) or null."""
    out = _neighbours(queries, curve, key, at, place, value, salts)
    b, a, t = F.col("_b"), F.col("_a"), F.col(at)
    line = F.when(a["t"] == b["t"], b["v"]).otherwise(b["v"] + (a["v"] - b["v"]) * (t - b["t"]) / (a["t"] - b["t"]))
    v = F.when(b.isNotNull() & a.isNotNull(), line)
    if clamp:
        v = F.coalesce(v, b["v"], a["v"])
    return out.withColumn(name, v).drop("_b", "_a")


def nearest_place(queries: DataFrame, curve: DataFrame, key: str, at: str, place: str = "tvt", value: str = "gr", salts: int = 1) -> DataFrame:
    """nearest_<place> and nearest_<value> of the nearest curve point; the lower one of two equally near."""
    out = _neighbours(queries, curve, key, at, place, value, salts)
    b, a, t = F.col("_b"), F.col("_a"), F.col(at)
    low = a.isNull() | (b.isNotNull() & (t - b["t"] <= a["t"] - t))
    return out.withColumns({f"nearest_{place}": F.when(low, b["t"]).otherwise(a["t"]), f"nearest_{value}": F.when(low, b["v"]).otherwise(a["v"])}).drop("_b", "_a")


def next_place(queries: DataFrame, curve: DataFrame, key: str, at: str, place: str = "tvt", value: str = "gr") -> DataFrame:
    """next_<place>: the curve's first place at or after the query's, its last one beyond the end."""
    out = _neighbours(queries, curve, key, at, place, value, 1)
    return out.withColumn(f"next_{place}", F.coalesce(F.col("_a.t"), F.col("_b.t"))).drop("_b", "_a")


def offset_misfits(queries: DataFrame, curve: DataFrame, key: str, at: str, observed: str, offsets: list[float], salts: int = 1) -> DataFrame:
    """A row for each query and offset: the observed value minus the curve's at the shifted place."""
    fan = queries.withColumn("offset", F.explode(F.array(*[F.lit(float(o)) for o in offsets]))).withColumn("_at", F.col(at) + F.col("offset"))
    out = interpolate(fan, curve, key, "_at", salts=salts)
    return out.withColumn("misfit", F.col(observed) - F.col("looked_up")).drop("_at")


def cumulative_area(curve: DataFrame, key: str, place: str = "tvt", value: str = "gr") -> DataFrame:
    """The curve with its trapezoid area from its start."""
    w = W.partitionBy(key).orderBy(place)
    step = (F.col(place) - F.lag(place).over(w)) * (F.col(value) + F.lag(value).over(w)) / 2.0
    return curve.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("area", F.sum("_step").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_step")


def _area_at(queries: DataFrame, curve: DataFrame, key: str, at: str, name: str) -> DataFrame:
    areas = cumulative_area(curve, key).select(key, "tvt", F.struct("gr", "area").alias("ga"))
    packed = areas.withColumns({"_g": F.col("ga.gr"), "_s": F.col("ga.area")})
    g = _neighbours(queries, packed.select(key, "tvt", F.col("_g").alias("gr")), key, at, "tvt", "gr", 1)
    g = g.withColumnsRenamed({"_b": "_gb", "_a": "_ga"})
    s = _neighbours(g, packed.select(key, "tvt", F.col("_s").alias("gr")), key, at, "tvt", "gr", 1)
    d, width = F.col(at) - F.col("_gb.t"), F.col("_ga.t") - F.col("_gb.t")
    slope = F.when(width == 0, 0.0).otherwise((F.col("_ga.v") - F.col("_gb.v")) / width)
    inside = F.col("_gb").isNotNull() & F.col("_ga").isNotNull()
    return s.withColumn(name, F.when(inside, F.col("_b.v") + F.col("_gb.v") * d + slope * d * d / 2.0)).drop("_b", "_a", "_gb", "_ga")


def window_average(queries: DataFrame, curve: DataFrame, key: str, at: str, half_width: float) -> DataFrame:
    """curve_average: the exact mean of the curve over a window around each place; null if it leaves the curve."""
    q = queries.withColumns({"_lo": F.col(at) - half_width, "_hi": F.col(at) + half_width})
    q = _area_at(_area_at(q, curve, key, "_lo", "_s0"), curve, key, "_hi", "_s1")
    return q.withColumn("curve_average", (F.col("_s1") - F.col("_s0")) / (2.0 * half_width)).drop("_lo", "_hi", "_s0", "_s1")


def gaussian(z2: Column) -> Column:
    """exp(-z2/2), with z2 capped at 600 and the result at least 1e-300."""
    return F.greatest(F.exp(-F.least(z2, F.lit(600.0)) / 2.0), F.lit(1e-300))


def likelihoods(z: Column) -> dict[str, Column]:
    """Likelihood kernels of a scaled residual."""
    a = F.abs(z)
    return {
        "gauss": gaussian(z * z),
        "student": F.pow(1.0 + z * z / 4.0, F.lit(-2.5)),
        "cauchy": 1.0 / (1.0 + z * z),
        "huber": F.exp(-F.when(a <= 1.5, z * z / 2.0).otherwise(1.5 * (a - 0.75))),
    }
