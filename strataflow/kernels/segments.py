"""A path put together of candidates, segment by segment, by a posterior over them; NumPy only."""

from __future__ import annotations

import numpy as np

from strataflow.kernels.filters import segment_posterior

#: Rows of a segment; weights of scores and of the geology's cost and its two parts; deviations of joints and of mean
#: levels, and the weight of the latter; share and bound of a move; greatest entropy and mean move of one that is made; scores that count.
LENGTH = 64
SCORE, GEOLOGY = 0.15, 0.4
DOWN, AGAIN = 0.70, 0.30
JOINT, JUMP, JUMP_SHARE = 2.0, 18.0, 0.35
ALPHA, CLIP = 0.64, 12.0
ENTROPY, MOVE, TOP = 1.01, 30.0, 8


def robust_z(x: np.ndarray) -> np.ndarray:
    """Distances from the median in scaled median deviations, in deviations where these are 0; 0 where both are or a value is missing."""
    have = np.isfinite(x)
    if not have.any():
        return np.zeros(len(x))
    mid = np.median(x[have])
    scale = 1.4826 * np.median(np.abs(x[have] - mid))
    if scale <= 1e-9:
        scale = x[have].std()
    return np.where(have, (x - mid) / scale, 0.0) if scale > 1e-9 else np.zeros(len(x))


def sequence_cost(levels: np.ndarray, curve_t: np.ndarray, label: np.ndarray, order: np.ndarray) -> float:
    """How little a path's formations come in their order: steps down among those that have a place in it, and labels that come again.

    A level has the formation of the next curve point at or above it, the last one beyond the end; ``order`` is below 0 without a place.
    """
    at = np.minimum(np.searchsorted(curve_t, levels, side="left"), len(curve_t) - 1)
    placed = order[at][order[at] >= 0]
    down = float(np.mean(np.diff(placed) < 0)) if len(placed) > 1 else 0.0
    runs = 1 + int((np.diff(label[at]) != 0).sum())
    return DOWN * down + AGAIN * max(runs - len(np.unique(label[at])), 0) / runs


def rank_cost(raw: np.ndarray) -> np.ndarray:
    """Ranks from 0 to 1, equal values in the order they come."""
    ranks = np.zeros(len(raw))
    if len(raw) > 1:
        ranks[np.argsort(raw, kind="stable")] = np.arange(len(raw)) / (len(raw) - 1)
    return ranks


def blended_path(paths: np.ndarray, scores: np.ndarray, curve_t: np.ndarray, label: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The mean of the candidate paths (K, n) in each segment, by forward-backward over segments.

    Candidates gain by their score and lose by the rank of their geology's cost in the segment; going from one to another costs the
    step at the joint and part of the difference of the segments' means.
    """
    k, n = paths.shape
    parts = [slice(a, min(a + length, n)) for a in range(0, n, length)]
    emit = np.tile(SCORE * robust_z(scores), (len(parts), 1))
    if len(curve_t):
        emit -= GEOLOGY * np.array([rank_cost(np.array([sequence_cost(p[s], curve_t, label, order) for p in paths])) for s in parts])
    mean = np.array([paths[:, s].mean(axis=1) for s in parts])
    joint = [np.abs(paths[:, a.stop - 1][:, None] - paths[:, b.start][None, :]) / JOINT for a, b in zip(parts[:-1], parts[1:], strict=True)]
    jump = np.abs(mean[:-1, :, None] - mean[1:, None, :]) / JUMP
    p = segment_posterior(emit, -(np.array(joint).reshape(len(parts) - 1, k, k) + JUMP_SHARE * jump))
    return np.concatenate([p[i] @ paths[:, s] for i, s in enumerate(parts)])


def moved(base: np.ndarray, path: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, bool]:
    """The base path moved toward another one, more so the farther along, unless the best scores say too little or the move is large."""
    ramp = 1 - np.exp(-np.arange(len(base)) / max(80.0, 0.12 * len(base)))
    out = base + ALPHA * np.clip(path - base, -CLIP, CLIP) * ramp
    top = np.sort(scores)[::-1][:TOP]
    w = np.exp(top - top.max())
    w = w[w > 0] / w.sum()
    entropy = float(-(w * np.log(w)).sum() / np.log(len(w))) if len(w) > 1 else 0.0
    made = entropy <= ENTROPY and float(np.abs(out - base).mean()) <= MOVE
    return (out, True) if made else (base, False)
