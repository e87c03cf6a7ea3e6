"""Regression trees for several folds at once: boosting that stops early, and extremely randomised trees.

Features are put into bins once. Rows of a fold with the same bins are in the same leaf of any tree, so that their number and
the sum and spread of their targets are all that learning needs: they are one cell, and passes are over cells. There are
never more cells than rows, and no more of them than combinations of bins, however long the table. A tree grows level by
level; for each level tasks sum the targets of their cells by (model, tree, node, feature, bin), and each node's split is chosen
where its sums meet. The models of all folds grow together, so a level is one pass over the cells however many folds and
trees there are, and only the chosen splits come to the driver.

Boosting: the pass for a tree's first level also sums the squared errors of each model's validation rows. A model
whose error has not fallen for ``patience`` rounds grows no more, and is cut back to its best round. Every ``FOLD_IN``
rounds predictions so far are written beside the rows, so that a pass walks few trees.

Extremely randomised trees: each node draws, for some features, one threshold each between the least and the greatest
bin of its rows, and takes the best of these; trees see all rows. Draws depend on seed, model, tree, node and feature only.

Defined cases: null and NaN features have a bin of their own, below all others; rows with null target are not learned
from, but predicted; without training rows a fold's predictions are null; constant features are never split; folds are not null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.sources.wells import written

#: Bins of a feature beside the one for missing values; rounds whose trees a pass walks.
BINS = 63
FOLD_IN = 5
#: Cells of a file, and of a block that a task holds at once.
CELLS_PER_FILE, CELL_BLOCK = 200_000, 30_000

_SUMS = pa.schema([("model", pa.int32()), ("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("n", pa.int64()), ("s", pa.float64())])
_SPLITS = "model int, tree int, node int, feature int, bin int, left_n long, left_s double, right_n long, right_s double"


@dataclass
class Tree:
    """A tree in heap order: node i has children 2i + 1 (bins up to ``bin``) and 2i + 2; leaves have feature -1."""

    depth: int
    feature: np.ndarray = field(default=None)
    bin: np.ndarray = field(default=None)
    value: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        if self.feature is None:
            size = (2 << self.depth) - 1
            self.feature, self.bin, self.value = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """Where the rows are, as far as the tree has grown."""
        at = np.zeros(len(bins), np.int64)
        inner = np.flatnonzero(self.feature >= 0)
        flat, row = bins.reshape(-1), np.arange(len(bins)) * bins.shape[1]
        for _ in range(int(inner[-1] + 1).bit_length() if len(inner) else 0):
            f = self.feature.take(at)
            down = 2 * at + 1 + (flat.take(row + np.maximum(f, 0)) > self.bin.take(at))
            at = np.where(f >= 0, down, at)
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins)]


def bin_edges(df: DataFrame, cols: list[str], bins: int = BINS) -> list[list[float]]:
    """For each column the distinct values that part it into about equal shares, from one pass."""
    shares = [i / bins for i in range(1, bins)]
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    row = df.agg(*[F.percentile_approx(number(c), shares, 100_000).alias(f"q{i}") for i, c in enumerate(cols)]).first()
    return [sorted(set(q)) if q else [] for q in row]


def binned(df: DataFrame, cols: list[str], target: str, fold: str, edges: list[list[float]]) -> DataFrame:
    """``df`` with _bins (a byte for each column, 0 where missing), _y and _fold, as a written table."""

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            b = np.zeros((len(f), len(cols)), np.uint8)
            for i, c in enumerate(cols):
                x = f[f"_x{i}"].to_numpy(float)
                b[:, i] = np.where(np.isnan(x), 0, 1 + np.searchsorted(edges[i], x, side="left"))
            out = f.drop(columns=[f"_x{i}" for i in range(len(cols))])
            out["_bins"] = [row.tobytes() for row in b]
            yield out

    x = df.select("*", *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)], F.col(target).cast("double").alias("_y"), F.col(fold).cast("int").alias("_fold"))
    kept = [f for f in x.schema.fields if not f.name.startswith("_x")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return written(x.mapInPandas(encode, f"{schema}, _bins binary"), "trees-rows")


def cells(rows: DataFrame) -> DataFrame:
    """Rows that can be learned from by fold and bins: their number _n, and of their targets the sum _s and the squared deviations from the mean _m, as a written table."""
    if "_m" in rows.columns:
        return rows
    some = rows.where("_y is not null and not isnan(_y)").groupBy("_fold", "_bins")
    found = written(some.agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_s"), (F.var_pop("_y") * F.count(F.lit(1))).alias("_m")), "trees-cells")
    # small files are read several to a task, few large ones leave cores idle
    files = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-found.count() // CELLS_PER_FILE))
    return written(found.repartition(files, "_fold", "_bins"), "trees-cells")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow's batches put together to larger ones, as each tree is a few NumPy calls for each."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= CELL_BLOCK:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The bytes of a binary column without nulls, a row for each value; read where Arrow has them."""
    places = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[places[0] : places[-1]].reshape(-1, width)


def _node_sums(bins: np.ndarray, at: np.ndarray, count: np.ndarray, total: np.ndarray, nodes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) by node, feature and bin for cells that are in one of ``nodes``."""
    place = np.full(int(max(at.max(initial=0), nodes.max(initial=0))) + 1, -1, np.int64)
    place[nodes] = np.arange(len(nodes))
    p = place[at]
    on = p >= 0
    p, b, c, t = (p, bins, count, total) if on.all() else (p[on], bins[on], count[on], total[on])
    p = p * width
    n, s = np.zeros((len(nodes), b.shape[1], width)), np.zeros((len(nodes), b.shape[1], width))
    for f in range(b.shape[1]):
        key = p + b[:, f]
        n[:, f] = np.bincount(key, c, len(nodes) * width).reshape(-1, width)
        s[:, f] = np.bincount(key, t, len(nodes) * width).reshape(-1, width)
    return n, s


def _emit(total: dict[tuple[int, int], list], nodes: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in _SUMS.names]
    for (m, t), (n, s) in total.items():
        i, f, b = np.nonzero(n)
        for col, v in zip(cols, (np.full(len(i), m), np.full(len(i), t), nodes[m, t][i], f, b, n[i, f, b], s[i, f, b]), strict=True):
            col.append(v)
    flat = [np.concatenate(c) if c else np.zeros(0) for c in cols]
    return pa.RecordBatch.from_arrays([pa.array(v.astype(t.type.to_pandas_dtype()), t.type) for v, t in zip(flat, _SUMS, strict=True)], schema=_SUMS)


def _best(n: np.ndarray, s: np.ndarray, rule: dict, key: tuple[int, int, int]) -> tuple | None:
    """(feature, bin, left n, left s, right n, right s) of a node's split from its (feature, bin) sums; None if no split helps."""
    left_n, left_s = np.cumsum(n, axis=1)[:, :-1], np.cumsum(s, axis=1)[:, :-1]
    all_n, all_s = n[0].sum(), s[0].sum()
    ridge = rule["ridge"]
    gain = left_s**2 / (left_n + ridge + 1e-300) + (all_s - left_s) ** 2 / (all_n - left_n + ridge + 1e-300) - all_s**2 / (all_n + ridge + 1e-300)
    allowed = (left_n >= rule["least"]) & (all_n - left_n >= rule["least"])
    if rule["random"]:
        drawn = np.zeros_like(allowed)
        for f in range(len(n)):
            some = np.flatnonzero(n[f])
            if len(some) > 1:
                u = np.random.default_rng([rule["seed"], *key, f]).random(2)
                # a threshold anywhere between the least and the greatest bin, for a share of the features
                if u[0] < rule["share"]:
                    drawn[f, int(some[0] + u[1] * (some[-1] - some[0]))] = True
        allowed &= drawn
    gain = np.where(allowed, gain, -np.inf)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    if not gain[f, b] > 1e-12 * max(abs(all_s**2 / max(all_n, 1)), 1e-300):
        return None
    return int(f), int(b), int(left_n[f, b]), float(left_s[f, b]), int(all_n - left_n[f, b]), float(all_s - left_s[f, b])


def _choose(rule: dict, features: int, width: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n, s = np.zeros((features, width)), np.zeros((features, width))
        # one row for each task that has any
        at = rows["feature"].to_numpy(), rows["bin"].to_numpy()
        np.add.at(n, at, rows["n"].to_numpy()), np.add.at(s, at, rows["s"].to_numpy())
        key = tuple(int(rows[c].iloc[0]) for c in ("model", "tree", "node"))
        # errors are not split, they pass through
        found = _best(n, s, rule, key) if key[1] >= 0 else None
        if found is None:
            found = -1, 0, int(n[0].sum()), float(s[0].sum()), 0, 0.0
        return pd.DataFrame([(*key, *found)], columns=[c.split()[0] for c in _SPLITS.split(", ")])

    return run


def _grow(rows: DataFrame, sums, rule: dict, features: int) -> tuple[list, list]:
    """The chosen splits of all nodes of a level, and the sums of errors, which come as tree -1."""
    added = rows.mapInArrow(sums, "model int, tree int, node int, feature int, bin int, n long, s double")
    found = added.groupBy("model", "tree", "node").applyInPandas(_choose(rule, features, BINS + 1), _SPLITS).collect()
    return [r for r in found if r.tree >= 0], [r for r in found if r.tree < 0]


def _apply(tree: Tree, split, rate: float, ridge: float) -> list[int]:
    """Enter a split into a tree; the children that may be split further."""
    i = split.node
    if split.feature < 0:
        tree.value[i] = rate * split.left_s / (split.left_n + ridge) if split.left_n else 0.0
        return []
    tree.feature[i], tree.bin[i] = split.feature, split.bin
    out = []
    for child, n, s in ((2 * i + 1, split.left_n, split.left_s), (2 * i + 2, split.right_n, split.right_s)):
        tree.value[child] = rate * s / (n + ridge)
        out.append(child)
    return out


@dataclass
class Boosted:
    """The models of all folds: their first guesses, trees by round, errors by round on validation rows, and best rounds."""

    start: list[float | None]
    trees: list[list[Tree]]
    errors: list[list[float]]
    best: list[int]


def boost(rows: DataFrame, folds: int, features: int, rounds: int = 40, patience: int | None = 4, rate: float = 0.2, depth: int = 4, least: int = 20, ridge: float = 1.0) -> Boosted:
    """Models that learn from the rows outside their fold, and stop by the error on the rows inside it (never, without ``patience``)."""
    rows = cells(rows)
    by = {r["_fold"]: (r.n, r.s) for r in rows.groupBy("_fold").agg(F.sum("_n").alias("n"), F.sum("_s").alias("s")).collect()}
    start = []
    for m in range(folds):
        n, s = (sum(v[i] for f, v in by.items() if f != m) for i in (0, 1))
        start.append(s / n if n else None)
    out = Boosted(start, [[] for _ in range(folds)], [[] for _ in range(folds)], [0] * folds)
    live = [m for m in range(folds) if start[m] is not None]
    rule = {"random": False, "ridge": ridge, "least": least}
    state = rows.withColumn("_pred", F.array(*[F.lit(s or 0.0) for s in start]))
    held = 0
    for step in range(rounds + 1):
        if step - held == FOLD_IN:
            state = written(_folded(state, out.trees, held, features), "trees-state")
            held = step
        grown = {m: Tree(depth) for m in live}
        frontier = {(m, 0): np.array([0]) for m in live}
        for level in range(depth):
            sums = _boost_sums(out.trees, grown, frontier, held, features, level == 0)
            splits, errors = _grow(state, sums, rule, features)
            if level == 0:
                for r in errors:
                    if r.left_n:
                        out.errors[r.model].append((r.left_s / r.left_n) ** 0.5)
                for m in list(live):
                    seen = out.errors[m]
                    # without validation rows all rounds count
                    out.best[m] = int(np.argmin(seen)) if seen and patience else step
                    if step == rounds or (seen and patience and len(seen) - 1 - out.best[m] >= patience):
                        live.remove(m)
                splits = [s for s in splits if s.model in live]
            frontier = {}
            for s in splits:
                if children := _apply(grown[s.model], s, rate, ridge):
                    frontier[s.model, 0] = np.append(frontier.get((s.model, 0), np.zeros(0, np.int64)), children)
            if not frontier:
                break
        for m in live:
            out.trees[m].append(grown[m])
        if not live:
            break
    out.trees = [t[: out.best[m]] for m, t in enumerate(out.trees)]
    return out


def _cell_columns(batch: pa.RecordBatch, features: int) -> tuple[np.ndarray, ...]:
    """(bins, fold, number, sum and spread of targets) of cells."""
    fold, count, total, spread = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_fold", "_n", "_s", "_m"))
    return _matrix(batch.column("_bins"), features), fold, count.astype(float), total, spread


def _boost_sums(trees, grown, frontier, held, features, first):
    """Sums of residuals of training cells by node; with ``first``, squared errors of validation cells too."""
    width = BINS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, errors = {}, {}
        for batch in _blocks(batches):
            bins, fold, count, total_y, spread = _cell_columns(batch, features)
            pred = batch.column("_pred").flatten().to_numpy().reshape(len(fold), -1)
            for (m, t), nodes in frontier.items():
                on = fold != m
                guess = pred[:, m] + sum((tree.predict(bins) for tree in trees[m][held:]), np.zeros(len(fold)))
                rest = total_y - count * guess
                if first:
                    own = ~on
                    e = errors.setdefault(m, [0, 0.0])
                    e[0], e[1] = e[0] + int(count[own].sum()), e[1] + float((spread[own] + rest[own] ** 2 / count[own]).sum())
                n, s = _node_sums(bins[on], grown[m].nodes(bins[on]), count[on], rest[on], nodes, width)
                held_sums = total.setdefault((m, t), [0.0, 0.0])
                held_sums[0], held_sums[1] = held_sums[0] + n, held_sums[1] + s
        if total:
            yield _emit(total, frontier)
        if errors:
            rows = [{"model": m, "tree": -1, "node": 0, "feature": 0, "bin": 0, "n": n, "s": s} for m, (n, s) in errors.items()]
            yield pa.RecordBatch.from_pylist(rows, schema=_SUMS)

    return run


def _folded(state: DataFrame, trees: list[list[Tree]], held: int, features: int) -> DataFrame:
    """``state`` with the trees since round ``held`` in its predictions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            bins = _matrix(batch.column("_bins"), features)
            pred = batch.column("_pred").flatten().to_numpy().reshape(len(bins), len(trees)).copy()
            for m, grown in enumerate(trees):
                for tree in grown[held:]:
                    pred[:, m] += tree.predict(bins)
            i = batch.schema.get_field_index("_pred")
            yield batch.set_column(i, "_pred", pa.array(list(pred), pa.list_(pa.float64())))

    return state.mapInArrow(run, state.schema)


def extra_trees(rows: DataFrame, folds: int, features: int, trees: int = 20, depth: int = 6, least: int = 5, share: float = 1.0, seed: int = 7) -> list[list[Tree]]:
    """For each fold, trees that have learned from all rows outside it."""
    rows = cells(rows)
    grown = {(m, t): Tree(depth) for m in range(folds) for t in range(trees)}
    frontier = {k: np.array([0]) for k in grown}
    rule = {"random": True, "ridge": 0.0, "least": least, "share": share, "seed": seed}
    for _ in range(depth):
        splits, _ = _grow(rows, _extra_sums(grown, frontier, features), rule, features)
        frontier = {}
        for s in splits:
            if children := _apply(grown[s.model, s.tree], s, 1.0, 0.0):
                k = (s.model, s.tree)
                frontier[k] = np.append(frontier.get(k, np.zeros(0, np.int64)), children)
        if not frontier:
            break
    return [[grown[m, t] for t in range(trees)] for m in range(folds)]


def _extra_sums(grown, frontier, features):
    width = BINS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in _blocks(batches):
            bins, fold, count, y, _ = _cell_columns(batch, features)
            outside = {m: (bins[on], count[on], y[on]) for m in {m for m, _ in frontier} for on in (fold != m,)}
            for (m, t), nodes in frontier.items():
                b, c, v = outside[m]
                n, s = _node_sums(b, grown[m, t].nodes(b), c, v, nodes, width)
                held = total.setdefault((m, t), [0.0, 0.0])
                held[0], held[1] = held[0] + n, held[1] + s
        if total:
            yield _emit(total, frontier)

    return run


def predicted(rows: DataFrame, models: dict[str, object], features: int) -> DataFrame:
    """``rows`` without helper columns, with a column for each model: ``Boosted``, or lists of trees whose mean counts."""
    names = list(models)
    kept = [f for f in rows.schema.fields if f.name not in ("_bins", "_y", "_fold")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} double" for n in names)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            bins = np.frombuffer(b"".join(f["_bins"]), np.uint8).reshape(len(f), features)
            fold = f["_fold"].to_numpy()
            out = f[[k.name for k in kept]].copy()
            for name in names:
                model, value = models[name], np.full(len(f), np.nan)
                for m in np.unique(fold).tolist():
                    on = fold == m
                    b = bins[on]
                    if isinstance(model, Boosted):
                        if model.start[m] is not None:
                            value[on] = model.start[m] + sum((t.predict(b) for t in model.trees[m]), np.zeros(len(b)))
                    else:
                        value[on] = np.mean([t.predict(b) for t in model[m]], axis=0)
                out[name] = value
            yield out

    out = rows.mapInPandas(run, schema)
    return out.withColumns({n: F.nanvl(F.col(n), F.lit(None).cast("double")) for n in names})


def boosted_out_of_fold(df: DataFrame, fold: str, cols: list[str], target: str, folds: int = 5, **options) -> tuple[DataFrame, Boosted]:
    """``df`` with ``prediction`` by a model that has not learned from the row's fold, and the models."""
    rows = binned(df, cols, target, fold, bin_edges(df, cols))
    models = boost(rows, folds, len(cols), **options)
    return predicted(rows, {"prediction": models}, len(cols)), models


def selector_out_of_fold(df: DataFrame, fold: str, cols: list[str], target: str, folds: int = 5, trees: int = 20, rounds: int = 20) -> DataFrame:
    """``df`` with ``extra``, ``boosted`` and their mean, ``prediction``, by models that have not learned from the row's fold.

    The boosted half has a fixed number of rounds, so nothing of a row's fold has a say in it.
    """
    rows = binned(df, cols, target, fold, bin_edges(df, cols))
    learned = cells(rows)
    extra = extra_trees(learned, folds, len(cols), trees)
    boosted = boost(learned, folds, len(cols), rounds=rounds, patience=None)
    out = predicted(rows, {"extra": extra, "boosted": boosted}, len(cols))
    return out.withColumn("prediction", 0.5 * F.col("extra") + 0.5 * F.col("boosted"))
