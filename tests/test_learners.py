"""Shards that resume, trees that grow over folds, detectors under nested validation: each against a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.operators import detectors as N
from strataflow.operators import shards as D
from strataflow.operators import trees as T
from strataflow.sources import wells as io


def doubled(rows):
    return rows.select("k", "i", (F.col("v") * 2).alias("w"))


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(k, i, float(k * 100 + i)) for k in range(40) for i in range(3)], "k long, i int, v double")


def test_killed_shards_are_computed_again_and_no_others(spark, table):
    root = io.folder(spark, "shards")
    first = D.run(table, "k", doubled, root, shards=8, wave=2, waves=2)
    assert len(first.computed) == 4 and not first.found and len(first.left) == 4
    broken = []

    def dies(rows):
        broken.append(1)
        return doubled(rows) if len(broken) == 1 else rows.select("k", "i", F.raise_error(F.lit("killed")).cast("double").alias("w"))

    with pytest.raises(Exception, match="killed"):
        D.run(table, "k", dies, root, shards=8, wave=2)
    with pytest.raises(ValueError, match="missing"):
        D.merge(table, "k", root, shards=8)
    last = D.run(table, "k", doubled, root, shards=8, wave=2)
    assert sorted(last.computed) == sorted(first.left[2:]) and len(last.found) == 6
    assert D.run(table, "k", doubled, root, shards=8).computed == []
    got = {(r.k, r.i, r.w) for r in D.merge(table, "k", root, shards=8, unique=["k", "i"]).collect()}
    assert got == {(r.k, r.i, r.v * 2) for r in table.collect()}


def test_changed_rows_and_parameters_make_shards_stale(spark, table):
    root = io.folder(spark, "shards")
    D.run(table, "k", doubled, root, shards=8, version=1)
    changed = table.withColumn("v", F.when(F.col("k") == 7, F.col("v") + 1).otherwise(F.col("v")))
    with pytest.raises(ValueError, match="made of other rows"):
        D.merge(changed, "k", root, shards=8, version=1)
    again = D.run(changed, "k", doubled, root, shards=8, version=1)
    assert len(again.computed) == 1 and len(again.found) == 7
    assert D.merge(changed, "k", root, shards=8, version=1).where("k = 7").agg(F.sum("w")).first()[0] == 2 * (700 + 701 + 702 + 3)
    with pytest.raises(ValueError, match="made of other rows or parameters"):
        D.merge(changed, "k", root, shards=8, version=2)
    assert len(D.run(changed, "k", doubled, root, shards=8, version=2).computed) == 8


def test_gaps_overlaps_and_strange_keys_fail(spark, table):
    root = io.folder(spark, "shards")
    D.run(table, "k", lambda rows: doubled(rows).where("k <> 9"), root, shards=4)
    with pytest.raises(ValueError, match="1 keys have no rows"):
        D.merge(table, "k", root, shards=4)
    root = io.folder(spark, "shards")
    D.run(table, "k", lambda rows: doubled(rows).unionByName(doubled(rows)), root, shards=4)
    with pytest.raises(ValueError, match="rows agree"):
        D.merge(table, "k", root, shards=4, unique=["k", "i"])
    with pytest.raises(ValueError, match="made rows of shards"):
        D.run(table, "k", lambda rows: doubled(rows).withColumn("k", F.col("k") + 1), io.folder(spark, "shards"), shards=4, wave=1)
    root = io.folder(spark, "shards")
    D.run(table, "k", doubled, root, shards=4)
    entries = spark.read.schema(D.LEDGER).json(f"{root}/ledger")
    entries.limit(1).write.mode("append").json(f"{root}/ledger")
    with pytest.raises(ValueError, match="committed twice"):
        D.merge(table, "k", root, shards=4)


def noisy(seed, n, folds=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(3)
    y = np.where(x[:, 0] > 0, 2.0, -1.0) + 0.5 * x[:, 1] + rng.normal(size=n) * 0.8
    x[rng.random(n) < 0.1, 2] = np.nan
    return x, y, rng.integers(0, folds, n)


def framed(spark, x, y, fold):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], float(t), int(f)) for i, (r, t, f) in enumerate(zip(x, y, fold, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, fold int")


def encoded(x, edges):
    return np.stack([np.where(np.isnan(x[:, i]), 0, 1 + np.searchsorted(edges[i], x[:, i], side="left")) for i in range(x.shape[1])], axis=1)


def plain_tree(b, y, rule, key, depth, rate=1.0):
    """A tree grown row by row: {node: (feature, bin)} and a value for each row."""
    splits, value = {}, np.zeros(len(y))

    def grow(node, rows, level):
        value[rows] = rate * y[rows].sum() / (len(rows) + rule["ridge"])
        if level == depth:
            return
        best = None
        for f in range(b.shape[1]):
            some = np.unique(b[rows, f])
            places = range(T.BINS) if not rule["random"] else []
            if rule["random"] and len(some) > 1:
                u = np.random.default_rng([rule["seed"], *key, node, f]).random(2)
                places = [int(some[0] + u[1] * (some[-1] - some[0]))] if u[0] < rule["share"] else []
            for p in places:
                left = b[rows, f] <= p
                nl, nr, sl, sr = left.sum(), (~left).sum(), y[rows][left].sum(), y[rows][~left].sum()
                if min(nl, nr) < max(rule["least"], 1):
                    continue
                gain = sl**2 / (nl + rule["ridge"]) + sr**2 / (nr + rule["ridge"]) - (sl + sr) ** 2 / (nl + nr + rule["ridge"])
                if best is None or gain > best[0] + 1e-9:
                    best = gain, f, p
        if best is None or best[0] <= 1e-9:
            return
        splits[node] = best[1:]
        left = b[rows, best[1]] <= best[2]
        grow(2 * node + 1, rows[left], level + 1)
        grow(2 * node + 2, rows[~left], level + 1)

    grow(0, np.arange(len(y)), 0)
    return splits, value


def test_extra_trees_split_like_a_plain_tree(spark):
    x, y, fold = noisy(1, 400)
    df = framed(spark, x, y, fold).repartition(5)
    edges = T.bin_edges(df, ["a", "b", "c"])
    rows = T.binned(df, ["a", "b", "c"], "y", "fold", edges)
    grown = T.extra_trees(rows, 4, 3, trees=3, depth=4, seed=11, share=0.8)
    b = encoded(x, edges)
    rule = {"random": True, "ridge": 0.0, "least": 5, "share": 0.8, "seed": 11}
    for m in range(4):
        for t, tree in enumerate(grown[m]):
            want, value = plain_tree(b[fold != m], y[fold != m], rule, (m, t), 4)
            assert {i: (int(tree.feature[i]), int(tree.bin[i])) for i in np.flatnonzero(tree.feature >= 0).tolist()} == want
            assert np.allclose(tree.predict(b[fold != m]), value)


def test_boosting_stops_where_more_rounds_get_worse(spark):
    x, y, fold = noisy(2, 300)
    df = framed(spark, x, y, fold).repartition(3)
    cols = ["a", "b", "c"]
    out, models = T.boosted_out_of_fold(df, "fold", cols, "y", folds=4, rounds=30, patience=3, depth=3, rate=0.5, least=5)
    edges = T.bin_edges(df, cols)
    b, got = encoded(x, edges), {r.id: r.prediction for r in out.collect()}
    rule = {"random": False, "ridge": 1.0, "least": 5}
    for m in range(4):
        train = fold != m
        pred, errors, at = np.full(len(y), y[train].mean()), [], []
        for _ in range(31):
            errors.append(float(np.sqrt(np.mean((y - pred)[~train] ** 2))))
            at.append(pred.copy())
            if len(errors) - 1 - int(np.argmin(errors)) >= 3:
                break
            splits, value = plain_tree(b[train], (y - pred)[train], rule, (m, 0), 3, 0.5)
            tree = T.Tree(3)
            for i, (f, p) in splits.items():
                tree.feature[i], tree.bin[i] = f, p
            places = tree.nodes(b[train])
            for i in np.unique(places):
                tree.value[i] = value[places == i][0]
            pred = pred + tree.predict(b)
        assert np.allclose(models.errors[m], errors) and models.best[m] == int(np.argmin(errors)) == len(models.trees[m])
        assert len(errors) - 1 > models.best[m]  # it went on, got worse and was cut back
        assert all(abs(got[i] - at[models.best[m]][i]) < 1e-9 for i in np.flatnonzero(~train).tolist())


def test_equal_rows_are_learned_from_once(spark, monkeypatch):
    """Passes are over cells, whose number does not grow with repeated rows; trees and errors are those of the rows."""
    x, y, fold = noisy(3, 60)
    more, shift = 5, np.linspace(-0.2, 0.2, 5)
    x5, y5, fold5 = np.repeat(x, more, axis=0), np.repeat(y, more) + np.tile(shift, len(y)), np.repeat(fold, more)
    edges = [sorted(set(np.quantile(x[:, i][~np.isnan(x[:, i])], [0.2, 0.4, 0.6, 0.8]).tolist())) for i in range(3)]
    cols = ["a", "b", "c"]
    rows = T.binned(framed(spark, x5, y5, fold5).repartition(3), cols, "y", "fold", edges)
    b = encoded(x5, edges)
    kinds = {(int(f), *r) for f, r in zip(fold5, b.tolist(), strict=True)}
    seen = []
    monkeypatch.setattr(T, "_grow", lambda table, *a, grow=T._grow: seen.append(table.count()) or grow(table, *a))
    boosted = T.boost(rows, 4, 3, rounds=2, patience=None, depth=2, least=5)
    extra = T.extra_trees(rows, 4, 3, trees=2, depth=3, least=5, seed=3)
    assert set(seen) == {len(kinds)} and len(kinds) <= 60
    for m in range(4):
        train, pred = fold5 != m, np.full(len(y5), y5[fold5 != m].mean())
        for r, error in enumerate(boosted.errors[m]):
            assert abs(error - np.sqrt(np.mean((y5 - pred)[~train] ** 2))) < 1e-9
            if r < 2:
                splits, value = plain_tree(b[train], (y5 - pred)[train], {"random": False, "ridge": 1.0, "least": 5}, (m, 0), 2, 0.2)
                tree = boosted.trees[m][r]
                assert {i: (int(tree.feature[i]), int(tree.bin[i])) for i in np.flatnonzero(tree.feature >= 0).tolist()} == splits
                assert np.allclose(tree.predict(b[train]), value)
                pred = pred + tree.predict(b)
        for t, tree in enumerate(extra[m]):
            rule = {"random": True, "ridge": 0.0, "least": 5, "share": 1.0, "seed": 3}
            assert np.allclose(tree.predict(b[train]), plain_tree(b[train], y5[train], rule, (m, t), 3)[1])


def test_odd_rows_of_trees(spark):
    df = spark.createDataFrame([(1, None, 0.0, None, None, 0), (2, 1.0, float("nan"), 2.0, 3.0, 1), (3, 1.0, 0.0, 2.0, 5.0, 1)], "id long, a double, b double, c double, y double, fold int")
    out = T.selector_out_of_fold(df, "fold", ["a", "b", "c"], "y", folds=2, trees=2, rounds=2)
    got = {r.id: r.prediction for r in out.collect()}
    assert got[1] == 4.0 and set(got) == {1, 2, 3}
    assert T.selector_out_of_fold(df.limit(0), "fold", ["a"], "y", folds=2, trees=1, rounds=1).count() == 0


def plain_logistic(x, y, c):
    w = np.where(y == 1, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max((1 - y).sum(), 1)))
    mean, dev = x.mean(axis=0), x.std(axis=0)
    a = np.concatenate([np.ones((len(x), 1)), (x - mean) / dev], axis=1)
    b = np.zeros(a.shape[1])
    d = np.append(1e-9, np.ones(x.shape[1])) / c
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ b))
        b = b - np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + np.diag(d), a.T @ (w * (p - y)) + d * b)
    return lambda v: 1 / (1 + np.exp(-(np.concatenate([np.ones((len(v), 1)), (v - mean) / dev], axis=1) @ b)))


def test_nested_detection_matches_plain_loops(spark):
    import hashlib

    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 2))
    y = (x[:, 0] + 0.5 * rng.normal(size=120) > 0.4).astype(float)
    df = spark.createDataFrame([(i, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))], "k long, a double, b double, t double").repartition(3)
    out, chosen = N.nested_detection(df, "k", ["a", "b"], "t", repeats=2, outer=3, inner=3, penalties=(0.01, 1.0))

    def deal(k, parts, *about):
        h = hashlib.md5(":".join(map(str, (k, *about))).encode()).hexdigest()
        return int((int(h[:13], 16) + 0.5) / 2**52 * parts)

    risk, flags = np.zeros(120), np.zeros(120)
    picked = {(r.repeat, r.outer): (r.penalty, r.threshold) for r in chosen.collect()}
    for r in range(2):
        outer = np.array([deal(k, 3, "outer", r) for k in range(120)])
        for o in range(3):
            train = np.flatnonzero(outer != o)
            inner = np.array([deal(k, 3, "inner", r, o) for k in train])
            best = None
            for c in (0.01, 1.0):
                s = np.zeros(len(train))
                for n in range(3):
                    s[inner == n] = plain_logistic(x[train][inner != n], y[train][inner != n], c)(x[train][inner == n])
                order = np.argsort(-s)
                hits = np.cumsum(y[train][order])
                precision = (y[train][order] * hits / np.arange(1, len(s) + 1)).sum() / hits[-1]
                f1 = 2 * hits / (np.arange(1, len(s) + 1) + hits[-1])
                if best is None or precision > best[0] + 1e-12:
                    best = precision, c, s[order][int(np.argmax(f1))]
            assert picked[r, o][0] == best[1] and abs(picked[r, o][1] - best[2]) < 1e-6
            p = plain_logistic(x[train], y[train], best[1])(x[outer == o])
            risk[outer == o] += p / 2
            flags[outer == o] += (p >= best[2]) / 2
    got = {r.k: r for r in out.collect()}
    assert len(got) == 120 and all(g.repeats == 2 for g in got.values())
    assert max(abs(got[k].risk - risk[k]) for k in range(120)) < 1e-6
    assert sum(abs(got[k].flagged - flags[k]) > 1e-9 for k in range(120)) <= 2  # those at a threshold
