"""HyperMinHash near duplicates against brute force over all pairs, and the sketch's own properties."""

import random

import numpy as np
import pytest

from strataflow.llm import hashing
from strataflow.llm import hyperminhash as H
from tests.llm.conftest import SCHEMA, prose


def brute(rows):
    """{doc_id: component_id} by all pairs of whole sets."""
    sets = {}
    for i, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
        sets[i] = set() if not w else {tuple(w)} if len(w) < 3 else {tuple(w[j : j + 3]) for j in range(len(w) - 2)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def edited(text, r, share):
    w = text.split(" ")
    for _ in range(int(len(w) * share)):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("block", [4096, 12])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(H, "BLOCK", block)
    monkeypatch.setattr(H, "SHARED", min(block, H.SHARED))
    r = random.Random(block)
    rows = []
    for k in range(12):
        base = prose(k, r.choice((4, 12, 60, 300)))
        rows += [(100 * k + j, edited(base, r, r.choice((0, 0.01, 0.02, 0.03, 0.05)))) for j in range(12)]
    # a large group of near copies, and pages that are half alike
    base = prose(99, 200)
    rows += [(5000 + j, edited(base, r, 0.02)) for j in range(80)]
    shared = prose(98, 150)
    rows += [(6000 + j, shared + " " + prose(200 + j, 60)) for j in range(60)]
    want, sizes = brute(rows)
    got = {x.doc_id: x for x in H.near_duplicates(frame(spark, rows)).collect()}
    assert {i: x.component_id for i, x in got.items()} == want
    assert all(x.n_shingles == sizes[i] and x.kept == (want[i] == i) for i, x in got.items())


def test_odd_documents(spark, odd_docs, no_docs):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in H.near_duplicates(odd_docs).collect()]
    by = {g[0]: g for g in got}
    assert len(got) == odd_docs.count() and sum(g[0] == 5 for g in got) == 2
    assert by[1][1:] == by[2][1:][:0] + (0, 1, True) and by[3][1:] == (0, 3, True)
    assert by[5][2:] == (4, False) and by[4][2:] == (4, True)
    assert by[None][2:] == (None, None) and by[7][1:] == (1, 7, True) and by[10][1] == 1
    assert H.near_duplicates(no_docs).collect() == []


def test_registers_hold_zeros_and_mantissa_and_none_is_empty():
    sets = [np.unique(np.random.default_rng(i).integers(0, 2**63, n, dtype=np.uint64)) for i, n in enumerate((1, 3, 200, 5000))]
    got = H.registers(sets)
    for s, regs in zip(sets, got, strict=True):
        h = hashing.mix(s ^ np.uint64(0xA0761D6478BD642F))
        least = {}
        for v in h.tolist():
            b = v & 255
            least[b] = min(least.get(b, 1 << 60), v >> 8)
        for b, v in least.items():
            zeros = 56 - v.bit_length()
            mantissa = ((v << (zeros + 1)) & ((1 << 56) - 1)) >> 46
            assert abs(int(regs[b]) - (zeros << 10 | mantissa)) <= 1
        assert set(regs.tolist()) <= {int(regs[b]) for b in least}


@pytest.mark.parametrize("n", [40, 150, 256, 2000])
def test_estimates_and_bands_find_pairs_at_the_limit(n):
    """Of 400 pairs at a similarity of 0.85 all share a band and none is ruled out; estimates are right on average."""
    rng = np.random.default_rng(n)
    common = round(n * 2 * 0.85 / 1.85)
    found = []
    for _ in range(400):
        x = rng.integers(0, 2**63, 2 * n - common, dtype=np.uint64)
        pair = H.registers([np.sort(x[:n]), np.sort(np.concatenate([x[:common], x[n:]]))])
        keys = H.band_keys(pair)
        assert (keys[0] == keys[1]).any()
        found.append(float(H.estimates(np.array([(pair[0] == pair[1]).mean()]), np.array([n]))[0]))
    assert abs(np.mean(found) - common / (2 * n - common)) < 0.01
    assert min(found) >= H.least_estimate(np.array([n]))[0]


def test_collisions_are_what_unlike_sets_share():
    rng = np.random.default_rng(3)
    n = 4096
    shared = [(a == b).mean() for a, b in (H.registers([np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for _ in range(2)]) for _ in range(300))]
    assert abs(np.mean(shared) - H.collisions(24)) < 4e-4
