"""Blends of model arms whose every number is fitted outside the fold that it is used in.

An arm is first limited to a reach around the median of the row's arms. Weights that are not negative and sum to one
have the least squared error; an odd cubic maps the blend's distance from the anchor arm; and a gate keeps the anchor
where two arms of a group agree, as the gain outside the fold decides. All fits come from sums by fold: one pass for
the weights, one for the cubics, one for the gates.

Defined cases: rows with a null arm or target are not fitted to; they get a blend where all arms are there. A fold without
rows outside has equal weights, no cubic and a closed gate.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def winsorised(df: DataFrame, arms: list[str], reach: float) -> DataFrame:
    """``df`` with arms no farther than ``reach`` from the median of the row's arms that are there."""
    there = F.array_sort(F.filter(F.array(*[F.col(a).cast("double") for a in arms]), lambda v: v.isNotNull()))
    n = F.size(there)
    at = lambda i: F.get(there, i.cast("int"))
    mid = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    out = df.withColumn("_mid", mid)
    limited = {a: F.when(F.col(a).isNotNull(), F.greatest(F.least(F.col(a), F.col("_mid") + reach), F.col("_mid") - reach)) for a in arms}
    return out.withColumns(limited).drop("_mid")


def fold_moments(df: DataFrame, arms: list[str], y: str, fold: str) -> DataFrame:
    """(fold, n, m_<i>_<j>): by fold the sums of products of the arms' errors."""
    full = F.col(y).isNotNull()
    for a in arms:
        full = full & F.col(a).isNotNull()
    e = {a: F.col(a) - F.col(y) for a in arms}
    sums = [F.sum(e[a] * e[b]).alias(f"m_{i}_{j}") for (i, a), (j, b) in _pairs(arms)]
    return df.where(full).groupBy(F.col(fold).alias("fold")).agg(F.count(F.lit(1)).alias("n"), *sums)


def _pairs(arms: list[str]):
    return [((i, a), (j, b)) for i, a in enumerate(arms) for j, b in enumerate(arms) if i <= j]


def simplex_weights(g: np.ndarray) -> np.ndarray:
    """Weights that are not negative, sum to one and make w'gw least: the best of the solutions on all sets of arms."""
    k = len(g)
    scale = max(float(np.abs(np.diag(g)).max(initial=0.0)), 1e-300)
    best, least = np.full(k, 1.0 / k), np.inf
    for size in range(1, k + 1):
        for some in combinations(range(k), size):
            part = g[np.ix_(some, some)] + 1e-12 * scale * np.eye(size)
            w = np.linalg.solve(part, np.ones(size))
            w = w / w.sum()
            value = float(w @ g[np.ix_(some, some)] @ w)
            if (w >= -1e-12).all() and value < least - 1e-12 * scale:
                best, least = np.zeros(k), value
                best[list(some)] = np.maximum(w, 0)
    return best / best.sum()


def outer_weights(moments: DataFrame, arms: list[str], folds: int) -> list[np.ndarray]:
    """For each fold the weights that the other folds' moments give; one row for each fold comes to the driver."""
    rows = {r.fold: r for r in moments.collect()}
    out = []
    for f in range(folds):
        g, n = np.zeros((len(arms), len(arms))), 0
        for other, r in rows.items():
            if other != f:
                n += r.n
                for (i, _), (j, _) in _pairs(arms):
                    g[i, j] += r[f"m_{i}_{j}"]
                    g[j, i] = g[i, j]
        out.append(simplex_weights(g / n) if n else np.full(len(arms), 1.0 / len(arms)))
    return out


def blend(arms: list[str], weights: np.ndarray) -> Column:
    return sum((F.col(a) * float(w) for a, w in zip(arms, weights, strict=True)), F.lit(0.0))


def by_fold(fold: str, values: list[Column]) -> Column:
    """The value of a row's fold."""
    return F.element_at(F.array(*values), F.col(fold).cast("int") + 1)


def odd_cubics(df: DataFrame, blends: list[Column], anchor: str, y: str, fold: str) -> list[tuple[float, float]]:
    """For each fold (a, b) of the least squares of y - anchor on a * d + b * d**3 over the other folds' rows, d being the blend's distance from the anchor.

    A row on which the moments are singular leaves b out, then a at 1.
    """
    sums = []
    t = F.col(y) - F.col(anchor)
    for f, b in enumerate(blends):
        d = F.when((F.col(fold) != f) & t.isNotNull(), b - F.col(anchor))
        sums += [F.sum(F.pow(d, 2)), F.sum(F.pow(d, 4)), F.sum(F.pow(d, 6)), F.sum(d * t), F.sum(F.pow(d, 3) * t)]
    row = [float(v) if v is not None else 0.0 for v in df.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
    out = []
    for f in range(len(blends)):
        d2, d4, d6, t1, t3 = row[5 * f : 5 * f + 5]
        det = d2 * d6 - d4 * d4
        if det > 1e-12 * max(d2 * d6, 1e-300):
            out.append(((t1 * d6 - t3 * d4) / det, (t3 * d2 - t1 * d4) / det))
        else:
            out.append((t1 / d2, 0.0) if d2 > 0 else (1.0, 0.0))
    return out


def gates(df: DataFrame, arms: list[str], new: list[Column], anchor: str, y: str, group: str, fold: str, grid: list[float]) -> list[tuple[str, str, float]]:
    """For each fold the pair of arms and the mean distance of them, from ``grid``, from which on groups leave the anchor.

    It has the greatest gain over the other folds; without any gain the distance is infinite. Ties go to the first pair, then
    to the greater distance.
    """
    pairs = list(combinations(arms, 2))
    t = F.col(y)
    gain = [F.sum(F.pow(F.col(anchor) - t, 2) - F.pow(n - t, 2)) for n in new]
    apart = [F.avg(F.abs(F.col(a) - F.col(b))) for a, b in pairs]
    g = df.groupBy(group, F.col(fold).alias("_f")).agg(F.array(*gain).alias("gain"), F.array(*apart).alias("apart"))
    g = g.select("_f", "gain", F.posexplode("apart").alias("pair", "d")).withColumn("grid", F.explode(F.array(*[F.lit(float(v)) for v in grid])))
    g = g.where(F.col("d") >= F.col("grid"))
    total = [F.coalesce(F.sum(F.when(F.col("_f") != f, F.get("gain", F.lit(f)))), F.lit(0.0)).alias(f"g{f}") for f in range(len(new))]
    rows = g.groupBy("pair", "grid").agg(*total).collect()
    out = []
    for f in range(len(new)):
        best = max(rows, key=lambda r: (r[f"g{f}"], -r.pair, r.grid), default=None)
        found = best is not None and best[f"g{f}"] > 0
        out.append((*pairs[best.pair], best.grid) if found else (*pairs[0], float("inf")))
    return out


def gated_blend(df: DataFrame, arms: list[str], y: str, group: str, fold: str, folds: int, reach: float, grid: list[float]) -> tuple[DataFrame, dict]:
    """``df`` with ``blend``, ``calibrated`` and ``prediction``, and what was fitted for each fold; the first arm is the anchor."""
    d = winsorised(df, arms, reach)
    anchor = arms[0]
    weights = outer_weights(fold_moments(d, arms, y, fold), arms, folds)
    blends = [blend(arms, w) for w in weights]
    cubics = odd_cubics(d, blends, anchor, y, fold)
    new = [F.col(anchor) + a * (b - F.col(anchor)) + c * F.pow(b - F.col(anchor), 3) for b, (a, c) in zip(blends, cubics, strict=True)]
    gate = gates(d, arms, new, anchor, y, group, fold, grid)
    apart = d.groupBy(group).agg(*[F.avg(F.abs(F.col(a) - F.col(b))).alias(f"_g{f}") for f, (a, b, _) in enumerate(gate)])
    out = d.join(apart, group).withColumns({"blend": by_fold(fold, blends), "calibrated": by_fold(fold, new)})
    is_open = by_fold(fold, [F.col(f"_g{f}") >= F.lit(v) for f, (_, _, v) in enumerate(gate)])
    out = out.withColumn("prediction", F.when(is_open, F.col("calibrated")).otherwise(F.col(anchor)))
    return out.drop(*[f"_g{f}" for f in range(folds)]), {"weights": weights, "cubics": cubics, "gates": gate}
