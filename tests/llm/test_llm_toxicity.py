"""The counterfactual penalty: an independent fit, and false positives on neutral mentions with and without it."""

from __future__ import annotations

import random

import numpy as np
import pytest

from strataflow.llm import toxicity

from .conftest import prose


def biased(n: int = 600, seed: int = 4) -> tuple[list[str], list[int]]:
    """Labelled texts in which toxic ones name a group far more often."""
    r = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        toxic = i % 2
        w = prose(i, 20, 5000).split()
        if toxic and r.random() < 0.8:
            w.append(r.choice(["grunt", "snark"]))
        if r.random() < (0.8 if toxic else 0.05):
            w.append(r.choice(["women", "muslims", "frauen", "juifs", "gitanos"]))
        texts.append(" ".join(w))
        labels.append(toxic)
    return texts, labels


def neutral_texts() -> list[str]:
    terms = ("women", "men", "muslims", "jews", "frauen", "juifs", "gitanos", "españoles")
    return [prose(9000 + i, 12, 5000) + " . " + t.format(term) for t in toxicity.TEMPLATES for i, term in enumerate(terms)]


def test_penalty_spares_neutral_mentions_and_keeps_insults():
    texts, labels = biased()
    fair, plain = toxicity.fit(texts, labels, 0.5), toxicity.fit(texts, labels, 0.5, penalty=0.0)
    false = [int((toxicity.score_block(m, neutral_texts()) >= 0.5).sum()) for m in (fair, plain)]
    assert false[0] == 0 and false[1] >= 10
    insults = [prose(7000 + i, 12, 5000) + " grunt snark" for i in range(20)]
    assert (toxicity.score_block(fair, insults) >= 0.5).all()


def test_weights_match_an_independent_fit():
    """Gradient descent on dense matrices of the same objective."""
    texts, labels = biased(200, 6)
    ids = toxicity.Identities()
    model = toxicity.fit(texts, labels, 0.5)

    def dense(rows: list[str]) -> np.ndarray:
        o, h = toxicity.features(rows)
        x = np.zeros((len(rows), len(model.keys)))
        at = np.minimum(np.searchsorted(model.keys, h), len(model.keys) - 1)
        on = model.keys[at] == h
        x[o[on], at[on]] = 1
        return x

    x, y = dense(texts), np.array(labels, float)
    pairs = ids.swaps(texts) + ids.neutral()
    delta = dense([a for a, _ in pairs]) - dense([b for _, b in pairs])
    lam, w, b = toxicity.RIDGE * len(y) / 100.0, np.zeros(x.shape[1]), 0.0
    top = np.linalg.eigvalsh(x.T @ x * 0.25 + toxicity.SWAP_PENALTY * delta.T @ delta)[-1] + lam + len(y)
    for _ in range(60_000):
        r = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - (x.T @ r + lam * w + toxicity.SWAP_PENALTY * (delta.T @ (delta @ w))) / top, b - r.sum() / top
    loss = lambda w, b: np.logaddexp(0, x @ w + b).sum() - y @ (x @ w + b) + lam / 2 * w @ w + toxicity.SWAP_PENALTY / 2 * ((delta @ w) ** 2).sum()
    assert loss(model.weights, model.bias) == pytest.approx(loss(w, b), rel=2e-2)
    assert np.abs(delta @ model.weights).max() < np.abs(model.weights).max()


def test_other_identities_and_none():
    mine = toxicity.Identities((("blue people", "green people"),), ("{} exist",))
    assert mine.swaps(["The Blue people came. Nothing else."]) == [("The Blue people came.", "The green people came."), ("The Blue people came.", "The blue people came.")]
    assert mine.neutral()[:2] == [("blue people exist", "green people exist"), ("blue people exist", " exist")]
    assert toxicity.Identities((), ()).swaps(["women"]) == [] and toxicity.Identities((), ()).neutral() == []
    texts, labels = biased(100)
    assert len(toxicity.fit(texts, labels, 0.5, toxicity.Identities((), ())).keys) >= 0
