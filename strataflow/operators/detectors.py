"""Logistic detectors under nested cross-validation.

Groups are dealt into outer folds, again for each repeat, and the groups outside an outer fold into inner ones, all by
MD5 so that any engine deals alike. For each outer fold every penalty is tried on the inner folds; the penalty of the
greatest average precision and the threshold of the greatest F1 are taken from the inner scores, and one model of that
penalty is fitted to all groups outside. The held-out groups see none of this. Models are fitted together by Newton's
method: in one pass each task adds gradients and curvatures of all models, and the driver sees these sums only.

Features are standardised by each model's own training groups, classes weigh alike.

Defined cases: null and NaN features count as the mean; groups with null label are scored, not learned from; constant
features have no weight; a training set of one class gives a model that knows this class only; ties of precision go to the
smaller penalty parameter, ties of F1 to the higher threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.functions.columns import hash_unit
from strataflow.operators.order import running
from strataflow.sources.wells import written

#: Inverse penalties that are tried.
PENALTIES = (0.03, 0.1, 0.3, 1.0)
STEPS, SETTLED = 25, 1e-9


def deal(key: str, parts: int, *about: str | int) -> Column:
    """The fold of a group, from 0."""
    return F.floor(hash_unit(F.col(key), *[F.lit(str(a)) for a in about]) * parts).cast("int")


class _Sets:
    """Training sets as (repeat, outer fold, inner fold or -1), with masks over rows of dealt folds."""

    def __init__(self, keys: list[tuple[int, int, int]]):
        self.keys = keys

    def mask(self, i: int, outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
        r, o, n = self.keys[i]
        out = outer[:, r] != o
        return out if n < 0 else out & (inner[:, r, o] != n)


def _read(frame: pd.DataFrame, repeats: int) -> tuple[np.ndarray, ...]:
    """(features, labels, outer folds by repeat, inner folds by repeat and outer fold)."""
    x, y = np.stack(frame["_x"].to_list()).astype(float), frame["_label"].to_numpy(float)
    outer = np.stack(frame["_outer"].to_list())
    return x, y, outer, np.stack(frame["_inner"].to_list()).reshape(len(frame), repeats, -1)


def _passed(rows: DataFrame, repeats: int, size: int, work) -> dict[int, np.ndarray]:
    """By number, the sums that ``work`` makes of a task's rows, added up over tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for f in frames:
            if len(f):
                for i, v in work(*_read(f, repeats)):
                    total[i] = total.get(i, 0.0) + v
        if total:
            yield pd.DataFrame({"model": list(total), "sums": [v.tolist() for v in total.values()]})

    sums = rows.mapInPandas(run, "model int, sums array<double>")
    added = sums.groupBy("model").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(size)])
    return {r[0]: np.array(r[1:], float) for r in added.collect()}


def _moments(rows: DataFrame, repeats: int, sets: _Sets, width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(means, deviations, weights of both classes) of each training set."""

    def work(x, y, outer, inner):
        for i in range(len(sets.keys)):
            on = sets.mask(i, outer, inner) & ~np.isnan(y)
            v, have = np.nan_to_num(x[on]), ~np.isnan(x[on])
            yield i, np.concatenate([have.sum(axis=0), v.sum(axis=0), (v**2).sum(axis=0), [(y[on] == 0).sum(), (y[on] == 1).sum()]]).astype(float)

    found = _passed(rows, repeats, 3 * width + 2, work)
    out = []
    for i in range(len(sets.keys)):
        s = found.get(i, np.zeros(3 * width + 2))
        n = np.maximum(s[:width], 1)
        mean = s[width : 2 * width] / n
        dev = np.sqrt(np.maximum(s[2 * width : 3 * width] / n - mean**2, 0))
        classes = s[-2:]
        out.append((mean, np.where(dev > 1e-9 * np.maximum(np.abs(mean), 1), dev, np.inf), classes.sum() / (2 * np.maximum(classes, 1))))
    return out


def _design(x: np.ndarray, mean: np.ndarray, dev: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(x), 1)), np.nan_to_num((x - mean) / dev)], axis=1)


def fit(rows: DataFrame, repeats: int, models: list[tuple[int, int, int, float]], width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(coefficients, means, deviations) of each model (repeat, outer, inner or -1, inverse penalty)."""
    keys = sorted({m[:3] for m in models})
    sets = _Sets(keys)
    moments = _moments(rows, repeats, sets, width)
    at = [keys.index(m[:3]) for m in models]
    size = width + 1
    now, trial = [np.zeros(size) for _ in models], [np.zeros(size) for _ in models]
    loss, live = [np.inf] * len(models), set(range(len(models)))
    for _ in range(STEPS):
        asked, tried = sorted(live), list(trial)

        def work(x, y, outer, inner, asked=asked, tried=tried):
            for i in asked:
                mean, dev, weight = moments[at[i]]
                on = sets.mask(at[i], outer, inner) & ~np.isnan(y)
                a, t = _design(x[on], mean, dev), y[on]
                z = a @ tried[i]
                p, w = 1 / (1 + np.exp(-np.clip(z, -500, 500))), weight[t.astype(int)]
                yield i, np.concatenate([[(w * (np.logaddexp(0, z) - t * z)).sum()], a.T @ (w * (p - t)), ((a * (w * p * (1 - p))[:, None]).T @ a).ravel()])

        sums = _passed(rows, repeats, 1 + size + size * size, work)
        for i in asked:
            s, c, b = sums.get(i), models[i][3], tried[i]
            if s is None:
                live.discard(i)
                continue
            penalty = np.append(1e-9, np.ones(width)) / c
            value = s[0] + 0.5 * (penalty * b * b).sum()
            if value > loss[i] + 1e-12 * abs(loss[i]):
                trial[i] = (now[i] + b) / 2
                if np.abs(trial[i] - now[i]).max() < SETTLED:
                    live.discard(i)
                continue
            now[i], loss[i] = b, value
            step = np.linalg.solve(s[1 + size :].reshape(size, size) + np.diag(penalty), s[1 : 1 + size] + penalty * b)
            trial[i] = b - step
            if np.abs(step).max() < SETTLED:
                live.discard(i)
        if not live:
            break
    return [(now[i], *moments[at[i]][:2]) for i in range(len(models))]


def _scores(rows: DataFrame, key: str, repeats: int, models, fitted, penalties: int) -> DataFrame:
    """(key, label, repeat, outer, penalty, score): inner models score their inner fold, others their outer fold."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            x, _, outer, inner = _read(f, repeats)
            for (r, o, n, c), (b, mean, dev) in zip(models, fitted, strict=True):
                on = np.flatnonzero((outer[:, r] == o) if n < 0 else (outer[:, r] != o) & (inner[:, r, o] == n))
                z = _design(x[on], mean, dev) @ b
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                yield pd.DataFrame({key: f[key].to_numpy()[on], "label": f["_label"].to_numpy()[on], "repeat": r, "outer": o, "penalty": c, "score": p})

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"`{key}` {kind}, label double, repeat int, outer int, penalty double, score double")


def choices(scores: DataFrame) -> DataFrame:
    """(repeat, outer, penalty, precision, threshold): of each outer fold the penalty of the greatest average precision of its inner scores."""
    keys = "repeat", "outer", "penalty"
    s = scores.where("label is not null").groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits"))
    s = running(s, [*keys, F.desc("score")], {"n0": F.col("n"), "hits0": F.col("hits")})
    each = s.groupBy(*keys).agg(F.min("n0").alias("n1"), F.min("hits0").alias("hits1"), F.sum("hits").alias("all"))
    s = s.join(each, list(keys))
    n, hits = F.col("n0") - F.col("n1") + F.col("n"), F.col("hits0") - F.col("hits1") + F.col("hits")
    precision = F.sum(F.when(F.col("all") > 0, F.col("hits") / F.col("all") * hits / n))
    f1 = F.struct((2 * hits / (n + F.col("all"))).alias("f1"), F.col("score"))
    each = s.groupBy(*keys).agg(F.coalesce(precision, F.lit(0.0)).alias("precision"), F.max(f1)["score"].alias("threshold"))
    best = F.max_by(F.struct("penalty", "precision", "threshold"), F.struct(F.round("precision", 12), -F.col("penalty")))
    return each.groupBy("repeat", "outer").agg(best.alias("b")).select("repeat", "outer", "b.*")


def nested_detection(
    df: DataFrame, key: str, cols: list[str], label: str, repeats: int = 3, outer: int = 5, inner: int = 4, penalties: tuple[float, ...] = PENALTIES
) -> tuple[DataFrame, DataFrame]:
    """(key, label, risk, flagged, repeats) of each row, one for a key, and what the inner folds chose by repeat and outer fold.

    ``risk`` is the mean score of the models that have not seen the row, ``flagged`` how often it reached the threshold.
    """
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    rows = written(
        df.select(
            key, F.array(*[number(c) for c in cols]).alias("_x"), F.col(label).cast("double").alias("_label"),
            F.array(*[deal(key, outer, "outer", r) for r in range(repeats)]).alias("_outer"),
            F.array(*[deal(key, inner, "inner", r, o) for r in range(repeats) for o in range(outer)]).alias("_inner"),
        ),
        "detector-rows",
    )
    grid = [(r, o, n, c) for r in range(repeats) for o in range(outer) for n in range(inner) for c in penalties]
    tried = _scores(rows, key, repeats, grid, fit(rows, repeats, grid, len(cols)), len(penalties))
    chosen = written(choices(tried), "detector-choices")
    # one row for each outer fold; a fold outside of which nothing has a label takes the strongest penalty
    best = {(r.repeat, r.outer): r.penalty for r in chosen.collect()}
    final = [(r, o, -1, best.get((r, o), min(penalties))) for r in range(repeats) for o in range(outer)]
    scored = _scores(rows, key, repeats, final, fit(rows, repeats, final, len(cols)), 1)
    flag = F.avg((F.col("score") >= F.coalesce("threshold", F.lit(0.5))).cast("double"))
    out = scored.join(chosen.select("repeat", "outer", "threshold"), ["repeat", "outer"], "left")
    out = out.groupBy(key).agg(F.max("label").alias("label"), F.avg("score").alias("risk"), flag.alias("flagged"), F.count(F.lit(1)).alias("repeats"))
    return out, chosen
