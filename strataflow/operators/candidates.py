"""Families of candidate paths for the hidden rows of wells, each a row by well, candidate and row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Fixed values of the families; a window of 0 is all known rows.
WINDOWS = (32, 64, 128, 256, 512, 0)
OFFSETS = (-0.012, -0.006, 0.0, 0.006, 0.012)
BLENDS = (0.0, 0.5)
KNOTS = 12
ENDS, SLOPES, CURVATURES = (-24.0, -12.0, 0.0, 12.0, 24.0), (-0.012, 0.0, 0.012), (-10.0, 0.0, 10.0)


def _fan(**axes) -> F.Column:
    """All combinations of the axes' values, exploded."""
    out = [{}]
    for name, values in axes.items():
        out = [{**o, name: v} for o in out for v in values]
    return F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in o.items()]) for o in out]))


def rate_candidates(rows: DataFrame, anchor: str) -> DataFrame:
    """Level plus z goes on at the rate of the last known rows: well_id, row_idx, window, offset, blend, tvt.

    A window is that many known rows at most, or all; rates are shifted by the offsets, and a blend of 0.5 takes half of the shape of
    the column ``anchor`` at the line's mean level. Windows of the same length are one. Wells need two known rows.
    """
    w = W.partitionBy("well_id")
    back = F.row_number().over(w.orderBy(F.desc("row_idx")))
    known = rows.where("tvt_input is not null").withColumns({"back": back, "known": F.count(F.lit(1)).over(w), "u": F.col("tvt_input") + F.col("z")})
    windows = F.array_distinct(F.array(*[F.lit(v) if v else F.col("known").cast("int") for v in WINDOWS]))
    in_window = known.withColumn("window", F.explode(windows)).where("back <= window")
    rates = in_window.groupBy("well_id", "window").agg(F.coalesce(F.regr_slope("u", "md"), F.lit(0.0)).alias("rate"))
    last = known.where("back = 1 and known >= 2").select("well_id", F.col("u").alias("last_u"), F.col("md").alias("last_md"))
    h = rows.where("tvt_input is null").select("well_id", "row_idx", "md", "z", F.col(anchor).alias("_anchor"))
    h = h.join(last, "well_id").join(rates, "well_id").withColumn("f", _fan(offset=OFFSETS, blend=BLENDS)).select("*", "f.*")
    line = F.col("last_u") + (F.col("rate") + F.col("offset")) * (F.col("md") - F.col("last_md")) - F.col("z")
    one = W.partitionBy("well_id", "window", "offset", "blend")
    h = h.withColumn("line", line)
    shaped = F.avg("line").over(one) + F.col("_anchor") - F.avg("_anchor").over(one)
    tvt = (1 - F.col("blend")) * F.col("line") + F.col("blend") * shaped
    return h.select("well_id", "row_idx", "window", "offset", "blend", tvt.alias("tvt"))


def piecewise_candidates(rows: DataFrame) -> DataFrame:
    """Broken lines from the last known level: well_id, row_idx, end, slope, curvature, tvt.

    At twelve knots, spread over the hidden rows, a candidate is the last level, plus a share of an endpoint, a slope along the well and an arc;
    between knots it is a line. Columns last_tvt_input and last_md are those of the last known row.
    """
    w = W.partitionBy("well_id")
    h = rows.where("tvt_input is null and last_tvt_input is not null")
    h = h.select("well_id", "row_idx", "md", "last_tvt_input", "last_md", (F.row_number().over(w.orderBy("row_idx")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    at = lambda j: F.floor(j * (F.col("n") - 1) / float(KNOTS - 1))
    # the knots that a row is; of knots on one row the last one counts
    hits = [F.when(at(F.lit(j)) == F.col("i"), j) for j in range(KNOTS)]
    h = h.withColumn("knot", F.coalesce(*reversed(hits)))
    share = F.col("knot") / float(KNOTS - 1)
    h = h.withColumn("f", _fan(end=ENDS, slope=SLOPES, curvature=CURVATURES)).select("*", "f.*")
    value = F.col("last_tvt_input") + F.col("end") * share + F.col("slope") * (F.col("md") - F.col("last_md")) + F.col("curvature") * 4 * share * (1 - share)
    here = F.when(F.col("knot").isNotNull(), F.struct(F.col("i").alias("i"), value.alias("v")))
    one = W.partitionBy("well_id", "end", "slope", "curvature")
    before = F.last(here, ignorenulls=True).over(one.orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    after = F.last(here, ignorenulls=True).over(one.orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0))
    h = h.withColumns({"_b": before, "_a": after})
    line = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * (F.col("i") - F.col("_b.i")) / (F.col("_a.i") - F.col("_b.i"))
    tvt = F.when(F.col("_a.i") == F.col("_b.i"), F.col("_b.v")).otherwise(line)
    return h.select("well_id", "row_idx", "end", "slope", "curvature", tvt.alias("tvt"))


def member_sidecar(members: DataFrame, key: str, width: float, tie: float) -> DataFrame:
    """By group, from (key, cand, family, score, delta): the best score, its margin, how far apart the two best are and whether they are
    of one family, how many others come within ``tie`` of the best, and the gap, size and number of clusters, which are bins of ``width`` levels.
    """
    w = W.partitionBy(key)
    r = members.withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "cand"))).withColumn("bin", F.floor(F.col("delta") / width))
    of = lambda c, n: F.max(F.when(F.col("r") == n, F.col(c)))
    near = F.count(F.when((F.col("score") >= F.col("_top") - tie) & (F.col("r") > 1), 1))
    t = r.withColumn("_top", F.max("score").over(w)).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), of("score", 1).alias("top1"), (of("score", 1) - of("score", 2)).alias("margin"),
        F.round(F.abs(of("delta", 1) - of("delta", 2)), 6).alias("apart"), (of("family", 1) == of("family", 2)).alias("same_family"), near.alias("near_ties"),
    )
    b = r.groupBy(key, "bin").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("m"))
    b = b.withColumn("r", F.row_number().over(w.orderBy(F.desc("best"), "bin")))
    c = b.groupBy(key).agg((of("best", 1) - of("best", 2)).alias("cluster_gap"), of("m", 1).alias("members"), F.count(F.lit(1)).alias("clusters"))
    return t.join(c, key)


def disagreement(rows: DataFrame, arms: list[str], anchor: str, key: str) -> DataFrame:
    """``rows`` with spread, mean and deviation of the arms, how far the mean is from the anchor, the share of arms above it, and by group the mean spread and the
    arm that is nearest to the mean on average.
    """
    there = F.array(*[F.col(a).cast("double") for a in arms])
    n = F.size("_m")
    out = rows.withColumn("_m", there)
    mean = F.aggregate("_m", F.lit(0.0), lambda s, v: s + v) / n
    out = out.withColumns({"mean": mean, "spread": F.array_max("_m") - F.array_min("_m")})
    square = F.aggregate(F.transform("_m", lambda v: (v - F.col("mean")) * (v - F.col("mean"))), F.lit(0.0), lambda s, v: s + v)
    out = out.withColumns({"std": F.sqrt(square / n), "move": F.col("mean") - F.col(anchor), "above": F.size(F.filter("_m", lambda v: v > F.col(anchor))) / n})
    w = W.partitionBy(key)
    far = F.array(*[F.struct(F.avg(F.abs(F.col(a) - F.col("mean"))).over(w).alias("d"), F.lit(a).alias("arm")) for a in arms])
    return out.withColumns({"group_spread": F.avg("spread").over(w), "central": F.array_min(F.transform(far, lambda s: F.struct(F.round(s["d"], 6).alias("d"), s["arm"].alias("arm"))))["arm"]}).drop("_m")
