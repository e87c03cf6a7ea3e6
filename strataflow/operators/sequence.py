"""Operators over keyed, ordered series: every one is a window over a total order within its key.

Rows are (key, order) unique. Where a window has no rows for a value the result is null, never NaN.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec

KEY, ORDER = "well_id", "row_idx"


def ordered(key: str = KEY, order: str = ORDER) -> WindowSpec:
    return W.partitionBy(key).orderBy(order)


def whole(key: str = KEY) -> WindowSpec:
    return W.partitionBy(key)


def so_far(key: str = KEY, order: str = ORDER) -> WindowSpec:
    return ordered(key, order).rowsBetween(W.unboundedPreceding, 0)


def known_counts(df: DataFrame, min_known: int = 10) -> DataFrame:
    """Wells with hidden rows and enough known ones, with both counts on every row."""
    k = F.count("tvt_input").over(whole())
    out = df.withColumns({"n_known": k, "n_hidden": F.count(F.lit(1)).over(whole()) - k})
    return out.where((F.col("n_hidden") > 0) & (F.col("n_known") >= min_known))


def anchors(df: DataFrame, *cols: str) -> DataFrame:
    """Columns last_<c> with the values of the last known row of each well."""
    names = cols or ("tvt_input", "z", "md")
    last = F.max(F.when(F.col("tvt_input").isNotNull(), F.struct(ORDER, *names))).over(whole())
    return df.withColumn("_a", last).withColumns({f"last_{c}": F.col(f"_a.{c}") for c in names}).drop("_a")


def relative_geometry(df: DataFrame) -> DataFrame:
    """Distance and direction since the anchor, and the place among the hidden rows from 0 to 1; hidden rows only."""
    a = anchors(df, "tvt_input", "x", "y", "z", "md").where(F.col("tvt_input").isNull())
    i, n = F.row_number().over(ordered()) - 1, F.count(F.lit(1)).over(whole())
    dx, dy = F.col("x") - F.col("last_x"), F.col("y") - F.col("last_y")
    return a.withColumns({
        "md_since": F.col("md") - F.col("last_md"),
        "dz": F.col("z") - F.col("last_z"),
        "dxy": F.sqrt(dx * dx + dy * dy),
        "frac": i / F.greatest(n - 1, F.lit(1)),
    })


def rolling(col: str | Column, width: int, kind: str = "mean", key: str = KEY, order: str = ORDER) -> Column:
    """A centred window of an odd number of rows, shorter at the ends."""
    if width % 2 == 0:
        raise ValueError("centred windows have an odd width")
    w = ordered(key, order).rowsBetween(-(width // 2), width // 2)
    c = F.col(col) if isinstance(col, str) else col
    if kind == "median":  # of a bounded frame: its middle values after sorting
        a = F.sort_array(F.collect_list(c).over(w))
        mid = lambda i: F.get(a, i.cast("int"))
        return (mid(F.floor((F.size(a) - 1) / 2)) + mid(F.floor(F.size(a) / 2))) / 2.0
    return {"mean": F.avg, "max": F.max, "min": F.min, "std": F.stddev_samp}[kind](c).over(w)


def difference(col: str, times: int = 1) -> Column:
    """First or second difference; 0 where there is no row before."""
    w = ordered()
    c = F.col(col)
    if times == 1:
        return F.coalesce(c - F.lag(col).over(w), F.lit(0.0))
    inner = F.coalesce(F.lag(col).over(w) - F.lag(col, 2).over(w), F.lit(0.0))
    return F.coalesce(c - F.lag(col).over(w) - inner, F.lit(0.0))


def gradient(col: str) -> Column:
    """Central differences, one-sided at the ends."""
    w = ordered()
    before, after, c = F.lag(col).over(w), F.lead(col).over(w), F.col(col)
    return F.when(before.isNull(), after - c).when(after.isNull(), c - before).otherwise((after - before) / 2.0)


def gradient_in_runs(df: DataFrame, col: str) -> DataFrame:
    """gradient_<col>: the gradient within each run of rows that have a value; null elsewhere and in runs of one."""
    missing = F.sum(F.col(col).isNull().cast("int")).over(so_far())
    out = df.withColumn("_run", F.when(F.col(col).isNotNull(), missing))
    w = W.partitionBy(KEY, "_run").orderBy(ORDER)
    b, a, c = F.lag(col).over(w), F.lead(col).over(w), F.col(col)
    g = F.when(b.isNull(), a - c).when(a.isNull(), c - b).otherwise((a - b) / 2.0)
    return out.withColumn(f"gradient_{col}", F.when(c.isNotNull(), g)).drop("_run")


def fill_linear(col: str, at: str = ORDER, fallback: Column | None = None) -> Column:
    """Missing values by linear interpolation along ``at``, the nearest known value beyond the ends, then the fallback."""
    here = F.when(F.col(col).isNotNull(), F.struct(F.col(at).cast("double").alias("t"), F.col(col).alias("v")))
    b = F.last(here, ignorenulls=True).over(so_far())
    a = F.first(here, ignorenulls=True).over(ordered().rowsBetween(0, W.unboundedFollowing))
    t = F.col(at).cast("double")
    line = b["v"] + (a["v"] - b["v"]) * (t - b["t"]) / (a["t"] - b["t"])
    filled = F.when(F.col(col).isNotNull(), F.col(col)).when(b.isNull(), a["v"]).when(a.isNull(), b["v"]).otherwise(line)
    return filled if fallback is None else F.coalesce(filled, fallback)


def step_length() -> Column:
    """Length of the move from the row before; 0 at the first row."""
    w = ordered()
    parts = [F.col(c) - F.lag(c).over(w) for c in ("x", "y", "z")]
    return F.coalesce(F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0])), F.lit(0.0))


def tortuosity(df: DataFrame, width: int) -> DataFrame:
    """Path length over straight distance across the last ``width`` rows (from the first row where there are fewer)."""
    out = df.withColumn("_path", F.sum(F.col("_step")).over(so_far())) if "_step" in df.columns else df.withColumn("_step", step_length()).withColumn("_path", F.sum("_step").over(so_far()))
    w, first = ordered(), F.first
    back = {c: F.coalesce(F.lag(c, width).over(w), first(c).over(so_far())) for c in ("x", "y", "z", "_path")}
    chord = F.sqrt(sum(((F.col(c) - back[c]) * (F.col(c) - back[c]) for c in ("y", "z")), (F.col("x") - back["x"]) * (F.col("x") - back["x"])))
    ratio = (F.col("_path") - back["_path"]) / chord
    return out.withColumns({"_r": ratio, "_c": chord}).withColumn("tortuosity", F.when(F.col("_c") > 1e-9, F.col("_r")).otherwise(F.lit(1.0))).drop("_step", "_path", "_r", "_c")


def azimuth(k: int, atan2: Callable[[Column, Column], Column] = F.atan2) -> Column:
    """Direction of the move over the last ``k`` rows."""
    w = ordered()
    back = {c: F.coalesce(F.lag(c, k).over(w), F.first(c).over(so_far())) for c in ("x", "y")}
    return atan2(F.col("y") - back["y"], F.col("x") - back["x"])


def c_atan2(y: Column, x: Column) -> Column:
    """The C library's atan2, which SQL engines call; the JVM's differs from it in the last bit of some angles, and so in which half turns count as jumps."""

    def run(y: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([math.atan2(*v) for v in zip(y.tolist(), x.tolist(), strict=True)], dtype=float)

    angle = F.pandas_udf(run, T.DoubleType())(y, x)
    return F.when(y.isNotNull() & x.isNotNull(), angle)


def unwrap(df: DataFrame, col: str) -> DataFrame:
    """unwrapped_<col>: an angle without its jumps of whole turns; for half turns to fall as in SQL it has to be ``c_atan2``'s."""
    d = F.col(col) - F.lag(col).over(ordered())
    turns = F.when(d > math.pi, -1).when(d < -math.pi, 1).otherwise(0)
    out = df.withColumn("_turn", F.coalesce(turns, F.lit(0)))
    return out.withColumn(f"unwrapped_{col}", F.col(col) + F.sum("_turn").over(so_far()) * (2 * math.pi)).drop("_turn")


def tail(df: DataFrame, n: int, condition: Column | None = None) -> DataFrame:
    """The last ``n`` rows of each well, of those that meet the condition."""
    rows = df if condition is None else df.where(condition)
    rank = F.row_number().over(W.partitionBy(KEY).orderBy(F.desc(ORDER)))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def first_hidden(df: DataFrame) -> DataFrame:
    """well_id, first_hidden, and whether the hidden rows are one run at the end."""
    hidden = F.col("tvt_input").isNull()
    g = df.groupBy(KEY).agg(
        F.min(F.when(hidden, F.col(ORDER))).alias("first_hidden"), F.max(F.when(~hidden, F.col(ORDER))).alias("last_known"), F.count(F.when(hidden, 1)).alias("n_hidden")
    )
    return g.select(KEY, "first_hidden", "n_hidden", (F.coalesce("last_known", F.lit(-1)) < F.coalesce("first_hidden", F.lit(1 << 60))).alias("is_suffix"))


def run_violations(df: DataFrame, code: str) -> DataFrame:
    """well_id, step_down (share of moves to a lower code), revisits (runs beyond the number of distinct codes, as a share of rows)."""
    w = ordered()
    before = F.lag(code).over(w)
    m = df.withColumns({"_down": (F.col(code) < before).cast("int"), "_new": (before.isNull() | (before != F.col(code))).cast("int")})
    n = F.count(F.lit(1))
    return m.groupBy(KEY).agg(
        (F.sum("_down") / F.greatest(n - 1, F.lit(1))).alias("step_down"), ((F.sum("_new") - F.count_distinct(code)) / n).alias("revisits")
    )
