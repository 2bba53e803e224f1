"""Small gradient-boosted trees for a bounded training sample, with isotonic calibration.

The sample's bound is the caller's parameter. Trees are complete, grown level by level over
binned features; a fitted model is a few kilobytes and scores whole arrays inside tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    base: float = 0.0
    depth: int = 3
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, penalty: float = 2.0, least: float = 4.0) -> Trees:
    """Logistic loss, second-order gains. ``penalty`` is added to hessian sums; a child has a hessian of ``least`` / 4 at least."""
    share = min(max(float(y.mean()) if len(y) else 0.0, 1e-4), 1 - 1e-4)
    model = Trees(float(np.log(share / (1 - share))), depth)
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    raw, inner = np.full(len(y), model.base), 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner, np.int64)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.full(width, 1e-9)
            for f in range(x.shape[1]):
                key = local * bins + binned[:, f]
                sums = [np.bincount(key, w, width * bins).reshape(width, bins).cumsum(1) for w in (g, h)]
                total = [s[:, -1:] for s in sums]
                left, right = sums, [t - s for t, s in zip(total, sums, strict=True)]
                gain = left[0] ** 2 / (left[1] + penalty) + right[0] ** 2 / (right[1] + penalty) - total[0] ** 2 / (total[1] + penalty)
                gain[(left[1] < least / 4) | (right[1] < least / 4)] = 0
                gain[:, len(edges[f]) :] = 0
                k = gain.argmax(1)
                better = gain[np.arange(width), k] > best
                for n in np.flatnonzero(better):
                    best[n] = gain[n, k[n]]
                    feature[first + n], at[first + n], cut[first + n] = f, k[n], edges[f][k[n]]
            split = np.isfinite(cut[node])
            node = 2 * node + 1 + (split & (binned[np.arange(len(y)), feature[node]] > at[node]))
        leaf = rate * np.bincount(node - inner, g, 2**depth) / (np.bincount(node - inner, h, 2**depth) + penalty)
        raw += leaf[node - inner]
        model.features.append(feature)
        model.cuts.append(cut)
        model.leaves.append(leaf)
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the least-squares non-decreasing fit of y on raw (pool adjacent violators)."""
    order = np.argsort(raw, kind="stable")
    at, sums, sizes = [], [], []
    for r, v in zip(raw[order].tolist(), y[order].tolist(), strict=True):
        at.append([r, r])
        sums.append(float(v))
        sizes.append(1)
        while len(sums) > 1 and sums[-2] * sizes[-1] >= sums[-1] * sizes[-2]:
            s, n, (_, b) = sums.pop(), sizes.pop(), at.pop()
            sums[-1] += s
            sizes[-1] += n
            at[-1][1] = b
    x = np.array([e for pair in at for e in pair] or [0.0])
    value = np.repeat(np.array(sums) / np.array(sizes), 2) if sums else np.array([0.0])
    return x, value


@dataclass
class Calibrated:
    trees: Trees
    at: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.raw(x), self.at, self.value) if len(x) else np.zeros(0)


def fit_calibrated(x: np.ndarray, y: np.ndarray, held: np.ndarray, **options) -> Calibrated:
    """Trees from the rows not ``held``, calibration from those that are."""
    if not held.any() or held.all():
        held = np.arange(len(y)) % 4 == 0
    trees = fit(x[~held], y[~held], **options)
    if not len(y):
        return Calibrated(trees, np.array([0.0]), np.array([0.0]))
    at, value = isotonic(trees.raw(x[held]), y[held]) if held.any() else (np.array([0.0]), np.array([float(y.mean())]))
    return Calibrated(trees, at, np.clip(value, 0, 1))
