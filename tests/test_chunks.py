"""Chunked recursions against the kernels that hold a well in one piece."""

import numpy as np
import pytest

from strataflow.operators import chunks as C
from strataflow.operators import decode as D


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(12)
    rows = []
    for well, n in ((1, 70), (2, 140), (3, 12), (4, 90), (5, 45)):
        tvt = 100 + np.cumsum(rng.normal(size=n) * 0.4)
        z = -np.cumsum(rng.uniform(0, 1, n))
        md = np.cumsum(rng.integers(0, 4, n)).astype(float)
        for i in range(n):
            known = i < n // 2 if well != 4 else i % 2 == 0
            gr = float(40 + 10 * np.sin(tvt[i] / 3) + rng.normal()) if rng.random() > 0.15 else None
            rows.append((well, well % 2, i * 2, float(md[i]), 0.0, 0.0, float(z[i]), gr, float(tvt[i]) if known else None))
    h = spark.createDataFrame(rows, "well_id long, curve_id long, row_idx long, md double, x double, y double, z double, gr double, tvt_input double").repartition(4)
    pts = [(c, float(t), float(40 + 10 * np.sin(t / 3) + c)) for c in (0, 1) for t in range(60, 141)]
    return h, spark.createDataFrame(pts, "curve_id long, tvt double, gr double")


@pytest.mark.parametrize("size", [10, 20, 1000])
def test_chunked_wells_equal_packed_ones(data, size):
    """With chunks of ten a well of 70 rows is cut into seven."""
    h, c = data
    chunks, packed = C.chunked(h, c, size=size), D.pack(h, c)
    kernels = {
        "states": (C.smooth_wells(chunks, C.States()), lambda w: D.state_smoother(w)["mean"], "mean"),
        "lattice": (C.smooth_wells(chunks, C.Lattice()), D.viterbi, "level"),
        "grid": (C.filter_wells(chunks, C.Grid()), D.grid_filter, "level"),
    }
    for name, (found, decode, column) in kernels.items():
        got = {(r.well_id, r.row_idx): r[column] for r in found.collect()}
        want = {(r.well_id, r.row_idx): r.value for r in D.paths(packed, decode).collect()}
        assert {k[0] for k in want} == {1, 2, 5} and want.keys() == got.keys(), name
        assert max(abs(got[k] - want[k]) for k in want) < 1e-6, name


@pytest.mark.parametrize("held", [1, 3])
def test_long_wells_go_back_by_some_chunks_at_a_time(data, held, monkeypatch):
    """Messages are written of wells that are not held whole only, one for each ``held`` chunks; results are those of packed wells."""
    h, c = data
    tables = {}
    monkeypatch.setattr(C, "written", lambda df, name, write=C.written: tables.setdefault(name, write(df, name)))
    for kernel, decode, column in ((C.States(), lambda w: D.state_smoother(w)["mean"], "mean"), (C.Lattice(), D.viterbi, "level")):
        tables.clear()
        got = {(r.well_id, r.row_idx): r[column] for r in C.smooth_wells(C.chunked(h, c, size=10), kernel, held).collect()}
        want = {(r.well_id, r.row_idx): r.value for r in D.paths(D.pack(h, c), decode).collect()}
        assert want.keys() == got.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-6
        # wells 1, 2 and 5 have 7, 14 and 5 chunks, the first hidden rows are in chunks 3, 7 and 2
        first, last = {1: 3, 2: 7, 5: 2}, {1: 6, 2: 13, 5: 4}
        assert {(r.well_id, r.chunk) for r in tables["messages"].collect()} == {(w, k) for w in first for k in range(first[w], last[w] + 1) if k == first[w] or k % held == 0}
    tables.clear()
    assert C.smooth_wells(C.chunked(h, c, size=10), C.States()).count() == len(want) and "messages" not in tables


def test_no_wells_give_no_rows(data):
    h, c = data
    assert C.smooth_wells(C.chunked(h.limit(0), c), C.Lattice()).count() == 0
    assert C.filter_wells(C.chunked(h.where("well_id = 4"), c), C.Grid()).count() == 0


def every_path(packed, arm, seeds, block):
    """(well, rows, all seeds' paths, their evidence) in one piece."""
    for r in packed.collect():
        w = D._well(r.asDict())
        if w.usable:
            paths, evidence = [], []
            for w.seed in range(seeds // block):
                p, e = arm(w)
                paths.append(p), evidence.append(e)
            yield w.well_id, w.hidden("row_idx").astype(int).tolist(), np.concatenate(paths), np.concatenate(evidence)


def test_ensembles_by_blocks_are_those_of_all_paths(data):
    """What blocks of seeds sum up gives the means by evidence and the deviations over all paths; nothing but a row for each block is dealt."""
    h, c = data
    packed, scales = D.pack(h, c), [1.0, 5.0]
    arms = [lambda w: D.filtered_block(w, 2, particles=30), lambda w: D.filtered_block(w, 2, particles=30, calibrate=True)]

    def finish(e):
        (level, spread), (other, _) = e["arms"]
        return {"row_idx": e["row_idx"].astype(int), "seeds": e["seeds"], "a": level[0], "b": level[1], "c": other[1], "s": spread}

    out = D.ensembles(packed, 6, 2, arms, scales, finish, "well_id long, row_idx long, seeds int, a double, b double, c double, s double")
    got = {(r.well_id, r.row_idx): (r.seeds, r.a, r.b, r.c, r.s) for r in out.collect()}
    want = {}
    for (well, rows, path, e), (_, _, other, f) in zip(every_path(packed, arms[0], 6, 2), every_path(packed, arms[1], 6, 2), strict=True):
        weigh = lambda p, e, scale: (np.exp((e - e.max()) / scale) @ p) / np.exp((e - e.max()) / scale).sum()
        for i, v in zip(rows, zip(weigh(path, e, 1.0), weigh(path, e, 5.0), weigh(other, f, 5.0), path.std(axis=0), strict=True), strict=True):
            want[well, i] = (6, *v)
    assert {k[0] for k in want} == {1, 2, 5} and got.keys() == want.keys()
    assert all(np.allclose(got[k], v, atol=1e-9) for k, v in want.items())
    with pytest.raises(ValueError, match="one size"):
        D.ensembles(packed, 5, 2, arms, scales, finish, "well_id long")
