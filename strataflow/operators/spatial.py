"""Nearest neighbours in the plane without a cross join, and what is fitted to them.

The plane is cut into square cells by count: cells of about sixteen times k points to begin with, and those that hold
far more into smaller ones. A query is sought in its own cell with a margin of a quarter of it, where a point is at most
once in each cell; cells are compared in NumPy, a block of queries with a block of points at a time. A query whose k-th
neighbour is no farther than the margin's edge is done, the others try again in cells sixteen times as large. A crowded
place is thus many small cells; one where many points coincide keeps as many of them as a query can need.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from strataflow.sources.wells import written

#: Points of a cell for each neighbour asked for, and how many times as many it holds before it is split; the finest cells.
CELL_POINTS, SPLIT, FINEST = 16, 4, 26
#: Points and queries of a block; distances that are held at once.
POINT_BLOCK, QUERY_BLOCK, HELD = 65_536, 16_384, 2_000_000
#: Queries of a block of wells, and points that a part of it has.
WELL_ROWS, WELL_POINTS = 4_096, 262_144
MARGIN = 0.25


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once, as a table in the shared folder."""
    return written(df, "cut")


def axis_scales(points: DataFrame) -> tuple[float, float, dict[str, float]]:
    """Population deviations of x and y (1 where below 0.001), and the extent of the cloud."""
    r = points.agg(
        F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.count(F.lit(1)).alias("n"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.percentile_approx("x", [0.05, 0.95]).alias("xm"), F.percentile_approx("y", [0.05, 0.95]).alias("ym"),
    ).first()
    scale = lambda s: s if s is not None and s >= 1e-3 else 1.0
    return scale(r["sx"]), scale(r["sy"]), r.asDict()


def knn_join(queries: DataFrame, points: DataFrame, k: int, query_id: str = "query_id", exclude: tuple[str, str] | None = None, sx: float = 1.0, sy: float = 1.0, extent: dict | None = None) -> DataFrame:
    """(query_id, point_id, value, px, py, dist, rank) of the k nearest points; distances that agree to nine places are ties, which go to the smaller point_id.

    ``exclude`` names a query and a point column that must differ (own well, own fold). Distances are scaled by ``sx`` and ``sy``.
    Queries and points without a coordinate take no part.
    """
    own, other = exclude or (None, None)
    # a struct's parts may be null as far as types go, which is what tables that are written and read again say
    named = lambda df, c: F.col(c).cast(df.schema[c].dataType.simpleString()).alias(c)
    q = queries.where("x is not null and y is not null").select(named(queries, query_id), (F.col("x") / sx).alias("qx"), (F.col("y") / sy).alias("qy"), (F.col(own) if own else F.lit(None).cast("int")).alias("_own"))
    p = points.where("x is not null and y is not null").select(named(points, "point_id"), "value", F.col("x").alias("px"), F.col("y").alias("py"), (F.col(other) if other else F.lit(None).cast("int")).alias("_other"))
    if extent is None:
        extent = axis_scales(points)[2]
    fields = [q.schema[0], *p.schema[:4], T.StructField("dist", T.DoubleType()), T.StructField("rank", T.IntegerType())]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    around = q.agg(F.min("qx").alias("x0"), F.max("qx").alias("x1"), F.min("qy").alias("y0"), F.max("qy").alias("y1")).first()
    if not extent["n"] or around.x0 is None:
        return q.sparkSession.createDataFrame([], schema)
    x0, y0 = min(extent["x0"] / sx, around.x0), min(extent["y0"] / sy, around.y0)
    grid = _Grid(x0, y0, max(extent["x1"] / sx - x0, extent["y1"] / sy - y0, around.x1 - x0, around.y1 - y0, 1e-9) * (1 + 1e-9), sx, sy)
    p, q = cut(p), cut(q)
    p, hot = _cells(p, grid, k, extent["n"], own is not None)
    q = q.withColumn("level", F.lit(_first_level(extent["n"], k)))
    for at, (crowded, finer) in sorted(hot.items()):
        q = q.withColumns({"_i": grid.cell("qx", "x", at), "_j": grid.cell("qy", "y", at)}).join(crowded.select("_i", "_j", F.lit(finer).alias("_finer")), ["_i", "_j"], "left")
        q = q.withColumn("level", F.coalesce("_finer", "level")).drop("_i", "_j", "_finer")
    found = None
    while True:
        near = cut(_search(q, p, grid, k, query_id, own is not None, schema))
        done = near.where((F.col("rank") == k) & (F.col("dist") <= F.col("edge")) | (F.col("edge") == float("inf"))).select(F.col(query_id).alias("_done")).distinct()
        part = near.drop("edge").join(done, F.col(query_id) == F.col("_done"), "left_semi")
        found = part if found is None else found.unionByName(part)
        # at level 0 a query has seen all points
        q = q.where("level > 0").join(done, F.col(query_id) == F.col("_done"), "left_anti")
        q = cut(q.withColumn("level", F.greatest(F.col("level") - 2, F.lit(0)).cast("int")))
        if q.isEmpty():
            return found


def _first_level(n: int, k: int) -> int:
    return max(0, min(FINEST, round(math.log(max(n / (CELL_POINTS * k), 1.0), 4))))


class _Grid:
    """Square cells over the plane: 2 ** level in each direction, so that coordinates are shares of the whole."""

    def __init__(self, x0: float, y0: float, across: float, sx: float, sy: float):
        self.x0, self.y0, self.across, self.sx, self.sy = x0, y0, across, sx, sy

    def share(self, col: str, axis: str) -> Column:
        """A scaled coordinate as a share of the way across."""
        return (F.col(col) - (self.x0 if axis == "x" else self.y0)) / self.across

    def of_point(self, axis: str) -> Column:
        col, scale, low = ("px", self.sx, self.x0) if axis == "x" else ("py", self.sy, self.y0)
        return (F.col(col) / scale - low) / self.across

    def cell(self, col: str, axis: str, level: int | Column) -> Column:
        v = self.of_point(axis) if col in ("px", "py") else self.share(col, axis)
        n = F.lit(2.0**level) if isinstance(level, int) else F.pow(F.lit(2.0), level)
        return F.floor(v * n).cast("long")


def _cells(p: DataFrame, grid: _Grid, k: int, n: int, grouped: bool) -> tuple[DataFrame, dict[int, tuple[DataFrame, int]]]:
    """(points, by level the cells to be split and the level they are split to); where points coincide in a finest cell, points without those that no query needs."""
    hot: dict[int, tuple[DataFrame, int]] = {}
    level, most = _first_level(n, k), SPLIT * CELL_POINTS * k
    rest = p
    while True:
        placed = rest.withColumns({"_i": grid.cell("px", "x", level), "_j": grid.cell("py", "y", level)})
        crowded = cut(placed.groupBy("_i", "_j").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most))
        top = crowded.agg(F.max("_n")).first()[0]
        if top is None:
            return p, hot
        if level >= FINEST:
            return _thinned(p, grid, crowded, k, grouped), hot
        rest = placed.join(crowded.select("_i", "_j"), ["_i", "_j"], "left_semi").drop("_i", "_j")
        finer = min(FINEST, level + max(1, math.ceil(math.log(top / (CELL_POINTS * k), 4))))
        hot[level], level = (crowded, finer), finer


def _thinned(p: DataFrame, grid: _Grid, crowded: DataFrame, k: int, grouped: bool) -> DataFrame:
    """Points without those of a crowded finest cell that coincide with enough others: of one place k of each group, and 2 k in all, have the nearest of any query."""
    p = p.withColumns({"_i": grid.cell("px", "x", FINEST), "_j": grid.cell("py", "y", FINEST)})
    inside = p.join(crowded.select("_i", "_j"), ["_i", "_j"], "left_semi")
    place = ("px", "py", "_other") if grouped else ("px", "py")
    # a group's rows are cut before they meet those of other groups
    some = inside.withColumn("_r", F.row_number().over(W.partitionBy(*place).orderBy("point_id"))).where(F.col("_r") <= k)
    some = some.withColumn("_r", F.row_number().over(W.partitionBy("px", "py").orderBy("point_id"))).where(F.col("_r") <= 2 * k)
    return cut(p.join(crowded.select("_i", "_j"), ["_i", "_j"], "left_anti").unionByName(some.drop("_r")).drop("_i", "_j"))


def _search(q: DataFrame, p: DataFrame, grid: _Grid, k: int, query_id: str, grouped: bool, schema: T.StructType) -> DataFrame:
    """The k nearest points that each query's cell and margin hold, with ``edge``, up to where they are known to be the nearest."""
    level = F.col("level")
    asked = q.withColumns({"_i": grid.cell("qx", "x", level), "_j": grid.cell("qy", "y", level)})
    tiles = cut(asked.groupBy("level", "_i", "_j").agg(F.count(F.lit(1)).alias("_nq")))
    levels = [r.level for r in tiles.select("level").distinct().collect()]
    size = F.pow(F.lit(2.0), level)
    # a point goes to its cell, and to those whose margin it is in
    at = lambda axis: F.array_distinct(F.transform(F.array(*[F.lit(v) for v in (-MARGIN, 0.0, MARGIN)]), lambda m: F.floor(grid.of_point(axis) * size + m).cast("long")))
    copies = p.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels]))).withColumn("_i", F.explode(at("x"))).withColumn("_j", F.explode(at("y")))
    keys = ["level", "_i", "_j"]
    counts = copies.join(tiles.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("_np"))
    blocks = cut(tiles.join(counts, keys).select(*keys, F.ceil(F.col("_nq") / QUERY_BLOCK).alias("_qb"), F.ceil(F.col("_np") / POINT_BLOCK).alias("_pb")))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = asked.join(blocks, keys).withColumns({"_q": F.pmod(F.xxhash64(query_id), "_qb")}).withColumn("_p", spread("_pb"))
    b = copies.join(blocks, keys).withColumns({"_p": F.pmod(F.xxhash64("point_id"), "_pb")}).withColumn("_q", spread("_qb"))
    group = [*keys, "_q", "_p"]
    a = a.select(*group, query_id, "qx", "qy", "_own", "_pb").groupBy(*group)
    b = b.select(*group, "point_id", "value", "px", "py", "_other").groupBy(*group)
    near = a.cogroup(b).applyInArrow(_nearest(grid, k, query_id, grouped), T.StructType([*schema, T.StructField("edge", T.DoubleType()), T.StructField("parts", T.LongType())]))
    whole = near.where("parts = 1")
    order = W.partitionBy(query_id).orderBy(F.round("dist", 9), "point_id")
    merged = near.where("parts > 1").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return whole.unionByName(merged).drop("parts")


def _ascending(ids: pa.Array) -> pa.Array:
    """The order of ids, a struct's by its parts in turn."""
    parts = ids.flatten() if pa.types.is_struct(ids.type) else [ids]
    names = [f"c{i}" for i in range(len(parts))]
    return pc.sort_indices(pa.table(parts, names=names), sort_keys=[(n, "ascending") for n in names])


def _nearest(grid: _Grid, k: int, query_id: str, grouped: bool):
    """The kernel of one block of queries and one of points."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        names = [query_id, "point_id", "value", "px", "py"]
        types = [a.schema.field(query_id).type, *(b.schema.field(c).type for c in names[1:])]
        b = b.take(_ascending(b.column("point_id").combine_chunks()))
        n = b.num_rows
        level = a.column("level")[0].as_py() if a.num_rows else 0
        cells = 2.0**level
        px, py = (b.column(c).to_numpy() / s for c, s in (("px", grid.sx), ("py", grid.sy)))
        qx, qy = a.column("qx").to_numpy(), a.column("qy").to_numpy()
        if grouped:
            codes = pd.factorize(pd.concat([a.column("_own").to_pandas(), b.column("_other").to_pandas()]), use_na_sentinel=False)[0]
            mine, theirs = codes[: len(qx)], codes[len(qx) :]
        rows, cols, dists = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        step = max(1, HELD // max(n, 1))
        for lo in range(0, len(qx) if n else 0, step):
            d = np.sqrt((px[None, :] - qx[lo : lo + step, None]) ** 2 + (py[None, :] - qy[lo : lo + step, None]) ** 2)
            if grouped:
                d[mine[lo : lo + step, None] == theirs[None, :]] = np.inf
            if n > k:
                # all that may tie with the k-th one
                limit = np.partition(d, k - 1, axis=1)[:, k - 1 : k] + 2e-9
                r, c = np.nonzero((d <= limit) & np.isfinite(d))
            else:
                r, c = np.nonzero(np.isfinite(d))
            v = d[r, c]
            order = np.lexsort((c, np.round(v, 9), r))
            r, c, v = r[order], c[order], v[order]
            keep = np.arange(len(r)) - np.searchsorted(r, r, side="left") < k
            rows.append(r[keep] + lo), cols.append(c[keep]), dists.append(v[keep])
        r, c, v = np.concatenate(rows), np.concatenate(cols), np.concatenate(dists)
        rank = np.arange(len(r)) - np.searchsorted(r, r, side="left") + 1
        edge = np.full(len(qx), np.inf)
        for x, low, axis in ((qx, grid.x0, "_i"), (qy, grid.y0, "_j")):
            i = a.column(axis)[0].as_py() if a.num_rows else 0
            at = (x - low) / grid.across * cells
            # what is beyond the outermost cells is nothing
            if i > 0:
                edge = np.minimum(edge, at - (i - MARGIN))
            if i < cells - 1:
                edge = np.minimum(edge, i + 1 + MARGIN - at)
        edge = edge * grid.across / cells * (1 - 1e-9) - 2e-9
        out = [a.column(query_id).combine_chunks().take(pa.array(r)), *(b.column(x).combine_chunks().take(pa.array(c)) for x in names[1:])]
        parts = a.column("_pb").to_numpy()[r] if len(r) else np.zeros(0, np.int64)
        arrays = [*(x.cast(t) for x, t in zip(out, types, strict=True)), pa.array(v), pa.array(rank, pa.int32()), pa.array(edge[r]), pa.array(parts, pa.int64())]
        return pa.table(arrays, names=[*names, "dist", "rank", "edge", "parts"])

    return run


def inverse_distance(near: DataFrame, query_id: str = "query_id", power: float = 1.0, offset: float = 1e-3, floor: float = 0.0) -> DataFrame:
    """Weighted mean, weighted deviation and nearest distance; weights are 1 / (max(dist, floor) + offset) ** power."""
    w = 1.0 / F.pow(F.greatest(F.col("dist"), F.lit(floor)) + offset, F.lit(power))
    g = near.withColumn("w", w).groupBy(query_id).agg(
        F.sum("w").alias("_w"), F.sum(F.col("w") * F.col("value")).alias("_wv"), F.sum(F.col("w") * F.col("value") * F.col("value")).alias("_wvv"),
        F.min("dist").alias("nearest"), F.count(F.lit(1)).alias("n_near"),
    )
    mean = F.col("_wv") / F.col("_w")
    return g.select(query_id, mean.alias("idw"), F.sqrt(F.greatest(F.col("_wvv") / F.col("_w") - mean * mean, F.lit(0.0))).alias("spread"), "nearest", "n_near")


def local_plane(near: DataFrame, queries: DataFrame, query_id: str = "query_id", weighted: bool = True) -> DataFrame:
    """The plane through each query's neighbours by (weighted) least squares: value at the query and both slopes; null where singular."""
    q = queries.select(query_id, F.col("x").alias("_qx"), F.col("y").alias("_qy"))
    r = near.join(q, query_id).withColumns({"u": F.col("px") - F.col("_qx"), "v": F.col("py") - F.col("_qy"), "w": 1.0 / (F.col("dist") + 1e-3) if weighted else F.lit(1.0)})
    s = lambda e, n: F.sum(F.col("w") * e).alias(n)
    u, v, z = F.col("u"), F.col("v"), F.col("value")
    m = r.groupBy(query_id).agg(s(F.lit(1.0), "s0"), s(u, "su"), s(v, "sv"), s(u * u, "suu"), s(u * v, "suv"), s(v * v, "svv"), s(z, "sz"), s(u * z, "suz"), s(v * z, "svz"))
    return m.select(query_id, *[c.alias(n) for n, c in zip(("plane", "slope_x", "slope_y"), cramer3(), strict=True)])


def cramer3() -> list[Column]:
    """Intercept and slopes from the moments s0, su, .. svz of a weighted plane fit."""
    c = {n: F.col(n) for n in ("s0", "su", "sv", "suu", "suv", "svv", "sz", "suz", "svz")}

    def det(m: list[list[Column]]) -> Column:
        (a, b, d), (e, f, g), (h, i, j) = m
        return a * (f * j - g * i) - b * (e * j - g * h) + d * (e * i - f * h)

    rows = [[c["s0"], c["su"], c["sv"]], [c["su"], c["suu"], c["suv"]], [c["sv"], c["suv"], c["svv"]]]
    right = [c["sz"], c["suz"], c["svz"]]
    whole = det(rows)
    scale = F.abs(c["s0"] * c["suu"] * c["svv"])
    out = []
    for k in range(3):
        m = [[right[i] if j == k else rows[i][j] for j in range(3)] for i in range(3)]
        out.append(F.when(F.abs(whole) > 1e-9 * scale, det(m) / whole))
    return out


def local_gradient(queries: DataFrame, support: DataFrame, points: DataFrame, k: int = 112, eps: float = 1e-6, tukey: float = 3.0, block_rows: int = WELL_ROWS, block_points: int = WELL_POINTS) -> DataFrame:
    """(well_id, row_idx, gx, gy): the gradient of a surface by the k nearest steps of a query's support wells.

    ``queries`` (well_id, row_idx, x, y), ``support`` (well_id, other), ``points`` (well_id, row_idx, x, y, dx, dy, ds). Steps
    weigh by inverse squared distance; a second fit weighs them by Tukey's biweight of the first one's residuals too.
    Null where the steps have one direction only. Queries and points with a missing value take no part. Work is that of a query
    and its support wells' points, but pairs are made in NumPy only: wells near each other are a block of about
    ``block_rows`` queries, to which each of their support wells' points goes once. A block with more than ``block_points``
    points, or a well with more queries, is dealt over parts, of which each gives the nearest steps it has.
    """
    whole = lambda df: df.dropna()
    q = whole(queries.select("well_id", "row_idx", "x", "y"))
    p = whole(points.select(F.col("well_id").alias("other"), F.col("row_idx").alias("_row"), F.col("x").alias("_px"), F.col("y").alias("_py"), "dx", "dy", "ds"))
    support = support.select("well_id", "other")
    blocks = _well_blocks(q, block_rows)
    need = cut(support.join(blocks.select("well_id", "_block"), "well_id").select("_block", "other").distinct())
    held = need.join(p.groupBy("other").agg(F.count(F.lit(1)).alias("_n")), "other").groupBy("_block").agg(F.sum("_n").alias("_n"))
    asked = blocks.groupBy("_block").agg(F.sum("_nq").alias("_nq"))
    # a block ends with the well that fills it, so only a long well makes it twice as large
    deal = asked.join(held, "_block").select("_block", F.ceil(F.col("_n") / block_points).alias("_pb"), F.ceil(F.col("_nq") / (2 * block_rows)).alias("_qb"))
    deal = cut(deal)
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    of = blocks.select("well_id", "_block").join(deal, "_block")
    none = lambda n, df, c: F.lit(None).cast(df.schema[c].dataType).alias(n)
    sought = q.join(of, "well_id").withColumns({"_q": F.pmod(F.xxhash64("row_idx"), "_qb")}).withColumn("_p", spread("_pb"))
    sought = sought.select("_block", "_q", "_p", "_pb", "well_id", "row_idx", "x", "y", none("other", support, "other"))
    pairs = support.join(of, "well_id").withColumn("_q", spread("_qb")).withColumn("_p", spread("_pb"))
    pairs = pairs.select("_block", "_q", "_p", "_pb", "well_id", none("row_idx", q, "row_idx"), none("x", q, "x"), none("y", q, "y"), "other")
    given = p.join(need, "other").join(deal, "_block").withColumns({"_p": F.pmod(F.xxhash64("other", "_row"), "_pb")}).withColumn("_q", spread("_qb"))
    group = ["_block", "_q", "_p"]
    kinds = {f.name: f.dataType.simpleString() for f in [*q.schema, *p.schema]}
    names = lambda *c: ", ".join(f"`{n}` {kinds.get(n, 'double')}" for n in c)

    def met(parts: Column, kernel, schema: str) -> DataFrame:
        a = sought.unionByName(pairs).where(parts).groupBy(*group)
        return a.cogroup(given.where(parts).drop("_pb", "_qb").groupBy(*group)).applyInArrow(kernel, schema)

    out = met(F.col("_pb") == 1, _gradients(k, eps, tukey), names("well_id", "row_idx", "gx", "gy"))
    if deal.where("_pb > 1").isEmpty():
        return out
    near = met(F.col("_pb") > 1, _nearest_steps(k), names("well_id", "row_idx", "other", "_row", "dist", "dx", "dy", "ds"))
    return out.unionByName(_gradients_of_rows(near, k, eps, tukey))


def _well_blocks(q: DataFrame, rows: int) -> DataFrame:
    """(well_id, _nq, _block): wells in the order of a Z curve through their centres, and which block of about ``rows`` queries each is in."""
    from strataflow.operators.order import running

    w = cut(q.groupBy("well_id").agg(F.count(F.lit(1)).alias("_nq"), F.avg("x").alias("_x"), F.avg("y").alias("_y")))
    r = w.agg(*[f(c).alias(f"{n}{c}") for c in ("_x", "_y") for n, f in (("lo", F.min), ("hi", F.max))]).first()

    def bits(c: str) -> Column:
        """A coordinate as sixteen bits with a gap after each."""
        lo, hi = r[f"lo{c}"] or 0.0, r[f"hi{c}"] or 0.0
        v = F.floor((F.col(c) - lo) / max(hi - lo, 1e-9) * 65535.0).cast("long")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    w = w.withColumn("_z", bits("_x").bitwiseOR(F.shiftleft(bits("_y"), 1)))
    w = running(w, [F.col("_z"), F.col("well_id")], {"_before": F.col("_nq")})
    return cut(w.select("well_id", "_nq", F.floor(F.col("_before") / rows).cast("long").alias("_block")))


def _wells_of_block(a: pa.Table, b: pa.Table, k: int):
    """For some queries of a well at a time: (their rows in ``a``, points, distances, which of them are among the k nearest); all points sorted by well and row."""
    b = b.take(pc.sort_indices(b, sort_keys=[("other", "ascending"), ("_row", "ascending")]))
    a = a.append_column("_at", pa.array(np.arange(a.num_rows)))
    queries = a.filter(pc.is_valid(a.column("row_idx"))).select(["_at", "well_id", "x", "y"]).to_pandas()
    pairs = a.filter(pc.is_valid(a.column("other"))).select(["well_id", "other"]).to_pandas()
    others = b.column("other").to_pandas()
    codes, uniques = pd.factorize(others)
    lo = np.searchsorted(codes, np.arange(len(uniques)))
    hi = np.append(lo[1:], len(codes))
    pairs["_c"] = pd.Index(uniques).get_indexer(pairs["other"])
    wells = {w: np.unique(c) for w, c in pairs.loc[pairs["_c"] >= 0].groupby("well_id")["_c"]}
    px, py = b.column("_px").to_numpy(), b.column("_py").to_numpy()
    for well, f in queries.groupby("well_id"):
        if well not in wells:
            continue
        # wells come in order, so that earlier points win ties
        at = np.concatenate([np.arange(lo[c], hi[c]) for c in wells[well]])
        rows, x, y = f["_at"].to_numpy(), f["x"].to_numpy(), f["y"].to_numpy()
        step = max(1, HELD // len(at))
        for i in range(0, len(rows), step):
            dx, dy = x[i : i + step, None] - px[at], y[i : i + step, None] - py[at]
            d = np.sqrt(dx * dx + dy * dy)
            near = np.ones(d.shape, bool)
            if len(at) > k:
                r = np.round(d, 9)
                last = np.partition(r, k - 1, axis=1)[:, k - 1 : k]
                near, tied = r < last, r == last
                room = k - near.sum(axis=1, keepdims=True)
                over = np.flatnonzero(tied.sum(axis=1, keepdims=True) > room)
                tied[over] &= np.cumsum(tied[over], axis=1) <= room[over]
                near |= tied
            yield b, rows[i : i + step], at, d, near


def _solved(w: np.ndarray, dx: np.ndarray, dy: np.ndarray, ds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes by least squares for each row of weights; NaN where the steps have one direction only."""
    xx, xy, yy, xs, ys = (w @ np.stack([dx * dx, dx * dy, dy * dy, dx * ds, dy * ds], axis=1)).T
    det = xx * yy - xy * xy
    good = det > 1e-6 * xx * yy
    det = np.where(good, det, 1.0)
    return np.where(good, (xs * yy - ys * xy) / det, np.nan), np.where(good, (ys * xx - xs * xy) / det, np.nan)


def _gradients(k: int, eps: float, tukey: float):
    """The kernel of a block whose points are in one part."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        rows, gx, gy = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
        steps = [b.column(c).to_numpy() for c in ("dx", "dy", "ds")] if not b.num_rows else None
        for points, at_rows, at, d, near in _wells_of_block(a, b, k):
            if steps is None:
                steps = [points.column(c).to_numpy() for c in ("dx", "dy", "ds")]
            dx, dy, ds = (s[at] for s in steps)
            far = np.maximum(d, eps)
            w = np.where(near, 1.0 / (far * far), 0.0)
            x, y = _solved(w, dx, dy, ds)
            u = (ds - x[:, None] * dx - y[:, None] * dy) / tukey
            v = 1.0 - u * u
            hx, hy = _solved(np.where(np.abs(u) < 1.0, w * v * v, 0.0), dx, dy, ds)
            rows.append(at_rows), gx.append(np.where(np.isnan(hx), x, hx)), gy.append(np.where(np.isnan(hy), y, hy))
        taken = pa.array(np.concatenate(rows))
        out = [a.column(c).combine_chunks().take(taken) for c in ("well_id", "row_idx")]
        return pa.table([*out, *(pa.array(np.concatenate(g), from_pandas=True) for g in (gx, gy))], names=["well_id", "row_idx", "gx", "gy"])

    return run


def _nearest_steps(k: int):
    """The kernel of one part of a block's points: the nearest steps of each query in it."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        points, rows, cols, dists = b, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for points, at_rows, at, d, near in _wells_of_block(a, b, k):  # noqa: B007
            r, c = np.nonzero(near)
            rows.append(at_rows[r]), cols.append(at[c]), dists.append(d[r, c])
        r, c = pa.array(np.concatenate(rows)), pa.array(np.concatenate(cols))
        out = {n: a.column(n).combine_chunks().take(r) for n in ("well_id", "row_idx")}
        out |= {n: points.column(n).combine_chunks().take(c) for n in ("other", "_row")} | {"dist": pa.array(np.concatenate(dists))}
        return pa.table(out | {n: points.column(n).combine_chunks().take(c) for n in ("dx", "dy", "ds")})

    return run


def _gradients_of_rows(near: DataFrame, k: int, eps: float, tukey: float) -> DataFrame:
    """The gradients by a row for each query and step, of which the k nearest count."""
    order = W.partitionBy("well_id", "row_idx").orderBy(F.round("dist", 9), "other", "_row")
    near = near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    near = near.withColumn("w", 1.0 / (F.greatest("dist", F.lit(eps)) * F.greatest("dist", F.lit(eps))))
    own = W.partitionBy("well_id", "row_idx")
    weighed = lambda w, e: F.sum(w * e).over(own)

    def solve(w: Column) -> tuple[Column, Column]:
        dx, dy, ds = F.col("dx"), F.col("dy"), F.col("ds")
        xx, xy, yy, xs, ys = (weighed(w, e) for e in (dx * dx, dx * dy, dy * dy, dx * ds, dy * ds))
        det = xx * yy - xy * xy
        good = det > 1e-6 * xx * yy
        return F.when(good, (xs * yy - ys * xy) / det), F.when(good, (ys * xx - xs * xy) / det)

    first = dict(zip(("_gx", "_gy"), solve(F.col("w")), strict=True))
    near = near.withColumns(first)
    u = (F.col("ds") - F.col("_gx") * F.col("dx") - F.col("_gy") * F.col("dy")) / tukey
    near = near.withColumn("w2", F.when(F.abs(u) < 1.0, F.col("w") * (1.0 - u * u) * (1.0 - u * u)).otherwise(0.0))
    second = dict(zip(("_hx", "_hy"), solve(F.col("w2")), strict=True))
    near = near.withColumns(second).where(F.col("_rank") == 1).select("well_id", "row_idx", *first, *second)
    return near.select("well_id", "row_idx", F.coalesce("_hx", "_gx").alias("gx"), F.coalesce("_hy", "_gy").alias("gy"))


def rotate(df: DataFrame, degrees: float, ratio: float) -> DataFrame:
    """ax, ay: coordinates turned by an angle, the second axis stretched by ``ratio``."""
    a = math.radians(degrees)
    x, y = F.col("x"), F.col("y")
    return df.withColumns({"ax": x * math.cos(a) + y * math.sin(a), "ay": (y * math.cos(a) - x * math.sin(a)) * ratio})


def centroids(df: DataFrame, key: str = "well_id") -> DataFrame:
    return df.groupBy(key).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
