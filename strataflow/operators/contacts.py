"""Formation contacts: where a path crosses formation tops, and candidate paths that keep the known distance to a top."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Known rows with a top at least, hidden ones at least, and their least share.
LEAST_KNOWN, LEAST_HIDDEN, HIDDEN_SHARE = 8, 4, 5


def intervals(geology: DataFrame) -> DataFrame:
    """(curve_id, formation, from, to): the levels of each formation's curve points, up to the top of the next one.

    ``geology`` is (curve_id, tvt, formation); a formation begins at its least level, the last one has no end.
    """
    tops = geology.where("formation is not null and tvt is not null").groupBy("curve_id", "formation").agg(F.min("tvt").alias("from"))
    return tops.withColumn("to", F.lead("from").over(W.partitionBy("curve_id").orderBy("from", "formation")))


def crossings(rows: DataFrame, tops: DataFrame, path: str = "tvt") -> DataFrame:
    """Where wells cross tops: well_id, curve_id, formation, row_idx, md, tvt, direction.

    ``rows`` has the wells' rows (well_id, curve_id, row_idx, md, z and the path), ``tops`` the elevation of each formation's top
    at a row (well_id, row_idx, formation, top). A well crosses between two rows, next to each other among those with
    both elevations, if it is above the top at one of them only; place and level are interpolated. Touching counts as
    below. ``row_idx`` is the later row.
    """
    d = rows.join(tops, ["well_id", "row_idx"]).where(F.col("top").isNotNull() & F.col("z").isNotNull() & F.col(path).isNotNull())
    d = d.select("well_id", "curve_id", "formation", "row_idx", "md", F.col(path).alias("level"), (F.col("z") - F.col("top")).alias("above"))
    o = W.partitionBy("well_id", "formation").orderBy("row_idx")
    before = {c: F.lag(c).over(o) for c in ("md", "level", "above")}
    d = d.withColumns({f"{c}0": v for c, v in before.items()}).where((F.col("above") > 0) != (F.col("above0") > 0))
    share = F.col("above0") / (F.col("above0") - F.col("above"))
    at = lambda c: F.col(f"{c}0") + share * (F.col(c) - F.col(f"{c}0"))
    direction = F.when(F.col("above") > 0, "up").otherwise("down")
    return d.select("well_id", "curve_id", "formation", "row_idx", at("md").alias("md"), at("level").alias("tvt"), direction.alias("direction"))


def inside(points: DataFrame, geology: DataFrame) -> DataFrame:
    """``points`` (curve_id, tvt, ...) with the formation whose levels they lie in, null above the first one."""
    i = intervals(geology).select("curve_id", F.col("formation").alias("inside"), "from", "to")
    hit = (F.col("tvt") >= F.col("from")) & (F.col("to").isNull() | (F.col("tvt") < F.col("to")))
    a, b = points.alias("a"), i.alias("b")
    return a.join(b, (F.col("a.curve_id") == F.col("b.curve_id")) & hit, "left").select("a.*", "inside")


def candidates(rows: DataFrame, tops: DataFrame, geology: DataFrame, anchor: str) -> DataFrame:
    """Hidden rows of each formation's candidate: well_id, row_idx, candidate, tvt, centred.

    The distance between path and top keeps its median over the known rows. ``centred`` is the shape of the column
    ``anchor`` at the mean level of the candidate. A formation that the curve has is a contact, another one a prior; one with too
    few known or hidden tops gives nothing. Rows without a top have no ``tvt``, but a ``centred`` one.
    """
    j = rows.join(tops, ["well_id", "row_idx"])
    known = F.col("tvt_input").isNotNull() & F.col("z").isNotNull()
    both = known & F.col("top").isNotNull()
    hidden = F.col("tvt_input").isNull()
    level = F.col("top") - F.col("z")
    facts = j.groupBy("well_id", "curve_id", "formation").agg(
        F.count(F.when(both, 1)).alias("known"),
        F.count(F.when(hidden & F.col("top").isNotNull(), 1)).alias("tops"),
        F.count(F.when(hidden, 1)).alias("hidden"),
        F.median(F.when(both, F.col("tvt_input") - level)).alias("offset"),
        F.avg(F.when(hidden, level)).alias("mean_level"),
        F.avg(F.when(hidden, F.col(anchor))).alias("mean_anchor"),
    )
    enough = (F.col("known") >= LEAST_KNOWN) & (F.col("tops") >= F.greatest(F.lit(LEAST_HIDDEN), F.floor(F.col("hidden") / HIDDEN_SHARE)))
    on_curve = geology.where("formation is not null and tvt is not null").select("curve_id", "formation").distinct().withColumn("listed", F.lit(True))
    facts = facts.where(enough).join(on_curve, ["curve_id", "formation"], "left")
    name = F.concat(F.when(F.col("listed"), "formation_contact:").otherwise("formation_contact_prior:"), F.col("formation").cast("string"))
    facts = facts.select("well_id", "formation", "offset", "mean_level", "mean_anchor", name.alias("candidate"))
    out = j.where(hidden).join(facts, ["well_id", "formation"])
    centred = F.col("offset") + F.col("mean_level") + F.col(anchor) - F.col("mean_anchor")
    return out.select("well_id", "row_idx", "candidate", (F.col("offset") + level).alias("tvt"), centred.alias("centred"))
