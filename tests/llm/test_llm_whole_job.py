"""Operators do the whole job on repeated rows and very long documents."""

import numpy as np

from strataflow.llm import mixing, neighbours


def ranked(spark, rows):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(d).collect())


def test_repeated_vectors_take_one_place(spark):
    x = np.random.default_rng(5).normal(size=(200, 8)).astype(np.float32)
    x[1:60] = x[1]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    want = ranked(spark, rows)
    s = x.astype(np.float64) @ x.astype(np.float64).T
    for q in range(0, 200, 20):
        best = sorted((-s[q, v], v) for v in range(200) if v != q)[:20]
        assert [(r[1], r[2]) for r in want if r[0] == q] == [(n + 1, v) for n, (_, v) in enumerate(best)]
    assert ranked(spark, rows + [rows[1]] * 50) == want
    assert ranked(spark, rows * 25) == want


def test_an_id_with_many_vectors_takes_one_place():
    x = np.stack([np.linspace(1.0, 1.5, 60), np.zeros(60)], axis=1).astype(np.float32)
    ids = np.array([7] * 30 + list(range(100, 130)))
    x = x[::-1].copy()
    graph = neighbours.Graph.build(neighbours.level_norms(x), np.zeros(60, np.int64))
    _, v, s = neighbours.match(graph, x, ids, np.arange(61), np.array([0]), np.array([[1.0, 0.0]]))
    assert v.tolist() == [7, *range(100, 119)] and s[0] == 1.5


def test_repeated_document_does_not_overshoot_the_mix(spark):
    """The closing document of a source is chosen by the words of all its rows."""
    from pyspark.sql import functions as F

    rows = [(1, "a", 60, 0.10), (2, "a", 500, 0.20)] + [(3, "a", 40, 0.30)] * 10 + [(4, "a", 38, 0.40)] + [(5, "b", 2, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long, u double")
    plan = mixing.fit(docs, weights=(100, 900), cap=1000)
    got = mixing.copies(docs, plan).where("source = 'a'")
    words, target = got.agg(F.sum(F.col("copies") * F.col("size")), F.max("target")).first()
    assert words == 98 and abs(target - 100) < 1


def test_doubles_keep_their_precision_and_range(spark):
    x = np.random.default_rng(6).normal(size=(120, 6)) * 1e60
    x[3] = x[4] * (1 + 1e-12)
    d = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(d).collect()
    s = x @ x.T
    for q in range(0, 120, 20):
        best = sorted((-s[q, v], v) for v in range(120) if v != q)[:20]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [v for _, v, _ in mine] == [v for _, v in best]
        assert np.allclose([m[2] for m in mine], [-b for b, _ in best], rtol=1e-12)
