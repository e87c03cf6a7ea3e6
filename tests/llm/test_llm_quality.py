"""Minimum-covariance-determinant verdicts against NumPy, and exact windows of long texts."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from strataflow.llm import quality

from .conftest import prose
from .test_llm_documents import brute_quality

D = quality.D


def _estimate(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean and scaled covariance of one group by plain NumPy."""
    floors = np.array(quality.RESOLUTION)
    q = np.percentile(np.round(x, 2), [25, 50, 75], axis=0)
    scale = np.maximum((q[2] - q[0]) / 1.349, floors)
    z = (x - q[1]) / scale
    size = np.linalg.norm(z, axis=1, keepdims=True)
    starts = [(q[1], np.diag(scale**2))]
    for y in (np.tanh(z), np.divide(z, size, out=np.zeros_like(z), where=size > 0)):
        second = y.T @ y / len(y)
        d = np.sqrt(np.diag(second))
        r = np.divide(second, np.outer(d, d), out=np.zeros_like(second), where=np.outer(d, d) > 0)
        np.fill_diagonal(r, 1.0)
        starts.append((q[1], r * np.outer(scale, scale) + np.diag(floors**2)))

    def distance(m, c):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    def step(m, c):
        bins = np.floor(np.log2(np.minimum(distance(m, c), quality.FAR) + 1) * quality.BINS)
        order, need = sorted(set(bins)), np.ceil(quality.KEEP * len(x))
        held = 0
        for edge in order:
            held += (bins == edge).sum()
            if held >= need:
                break
        kept = x[bins <= edge]
        return kept.mean(0), np.cov(kept.T, bias=True) + np.diag(floors**2)

    done = []
    for k, (m, c) in enumerate(starts):
        for _ in range(quality.START_STEPS):
            m, c = step(m, c)
        done.append((np.linalg.slogdet(c)[1], k, m, c))
    return min(done, key=lambda d: d[:2])[2:], step, distance


def _models(groups: dict, steps: int | None = None):
    """The estimates of all groups, in as many C-steps as the one that settles last."""
    state = {g: _estimate(x) for g, x in groups.items()}
    now = {g: s[0] for g, s in state.items()}
    for k in range(quality.C_STEPS):
        after = {g: state[g][1](*now[g]) for g in now}
        moved = max(abs(np.linalg.slogdet(after[g][1])[1] - np.linalg.slogdet(now[g][1])[1]) for g in now)
        now = after
        if k % quality.LOOK == quality.LOOK - 1 and moved < quality.SETTLED:
            break
    out = {}
    for g, (m, c) in now.items():
        median = np.median(np.round(np.minimum(state[g][2](m, c), 400.0), 1))
        out[g] = m, c * max(median / quality.CHI2_MEDIAN, 1.0), len(groups[g])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_centre_covariance_distance_and_verdict_match_numpy(spark, seed):
    r, rows = random.Random(seed), []
    for i in range(260):
        text = prose(i, r.randrange(50, 260), 3000)
        if r.random() < 0.12:
            text = " ".join(w + r.choice(["#", "|*", "x" * 9, ""]) for w in text.split())
        if r.random() < 0.08:
            text += ("\n" + prose(1000 + i, 6)) * r.randrange(2, 12)
        rows.append((i, text, r.choice(["en", "en", "de", None]), r.choice(["a", "a", "b", "c", None])))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    stats = quality.with_features(quality.with_statistics(d)).collect()
    passed = [x for x in stats if not x.q_base_failed]
    groups: dict = {}
    for x in passed:
        for g in ((0, x.lang, x.source), (1, x.lang, None), (2, None, None)):
            groups.setdefault(g, []).append([x[f] for f in quality.FEATURES])
    models = _models({g: np.array(v) for g, v in groups.items()})
    got = {x.doc_id: x for x in quality.quality(d).collect()}
    fitted = {(m.level, m.g_lang, m.g_source): m for m in quality.fit(spark.createDataFrame(passed, d_schema(spark, d)).where("true")).collect()}
    for g, (m, c, n) in models.items():
        assert fitted[g].g_n == n and [fitted[g][f"m{j}"] for j in range(D)] == pytest.approx(m, abs=1e-6)
        assert [fitted[g][f"c{i}{j}"] * fitted[g].g_scale for i in range(D) for j in range(i + 1)] == pytest.approx([c[i, j] for i in range(D) for j in range(i + 1)], abs=1e-6)
    rejected = 0
    for x in stats:
        m, c, _ = models[(2, None, None)]
        for g in ((1, x.lang, None), (0, x.lang, x.source)):
            own = models.get(g)
            w = own[2] / (own[2] + quality.SHRINK) if own else 0.0
            m, c = (w * own[0] + (1 - w) * m, w * own[1] + (1 - w) * c) if own else (m, c)
        f = np.array([x[k] for k in quality.FEATURES]) - m
        distance = f @ np.linalg.inv(c) @ f
        assert got[x.doc_id].distance == pytest.approx(distance, rel=1e-6, abs=1e-9)
        assert got[x.doc_id].kept == (not x.q_base_failed and distance <= quality.CUTOFF)
        rejected += not x.q_base_failed and distance > quality.CUTOFF
    assert rejected > 5


def d_schema(spark, d):
    return quality.with_features(quality.with_statistics(d)).schema


def test_every_statistic_can_reject_alone(spark):
    clean = [(i, "\n".join(prose(i * 10 + k, 20, 3000) for k in range(6)), "en", "a") for i in range(120)]
    odd = [
        (1000, clean[0][1].replace("w", "www" + "v" * 3), "en", "a"),
        (1001, clean[1][1] + " #" * 60, "en", "a"),
        (1002, clean[2][1] + "\n- x" * 12, "en", "a"),
        (1003, clean[3][1] + " " + " ".join(prose(77, 25, 3000).split() * 2), "en", "a"),
    ]
    d = spark.createDataFrame(clean + odd, "doc_id long, text string, lang string, source string")
    gone = {x.doc_id for x in quality.quality(d).where("not kept and not base_failed").collect()}
    assert {1000, 1001, 1002} <= gone and len(gone - {1000, 1001, 1002, 1003}) <= 2


def test_windows_of_long_texts_are_exact(spark, monkeypatch):
    """Texts beyond the packed places go by whole hashes."""
    monkeypatch.setattr(quality, "PLACE_BITS", 6)
    r = random.Random(3)
    texts = {i: " ".join(f"w{r.randrange(v)}" for _ in range(n)) for i, (n, v) in enumerate([(3, 2), (63, 4), (64, 4), (65, 9), (400, 12), (900, 60)])}
    d = spark.createDataFrame([(i, t, "en", "a") for i, t in texts.items()], "doc_id long, text string, lang string, source string")
    for x in quality.with_statistics(d).collect():
        assert x.q_n_repeat_words == brute_quality(texts[x.doc_id])[4]
    assert Counter(len(t.split()) >= 64 for t in texts.values())[True] == 4
