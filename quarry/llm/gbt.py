"""Gradient-boosted trees for dense features, with isotonic calibration.

Fitting runs in the driver on a sample whose size its caller bounds. A fitted model is a handful of
small arrays: it scores NumPy matrices in a task, or turns into one SQL expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A split (``x[feature] < cut`` goes left) or, without children, a leaf."""

    value: float
    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None


@dataclass(frozen=True)
class Model:
    base: float
    trees: tuple[Node, ...]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            _add(tree, x, np.arange(len(x)), out)
        return out

    def margin_column(self, features: list[Column]) -> Column:
        """The same margin as a Catalyst expression over feature columns."""
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + _column(tree, features)
        return total


def _add(node: Node, x: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    if node.left is None or node.right is None:
        out[at] += node.value
        return
    low = x[at, node.feature] < node.cut
    _add(node.left, x, at[low], out)
    _add(node.right, x, at[~low], out)


def _column(node: Node, features: list[Column]) -> Column:
    if node.left is None or node.right is None:
        return F.lit(node.value)
    return F.when(features[node.feature] < node.cut, _column(node.left, features)).otherwise(_column(node.right, features))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 2.0
) -> Model:
    """Newton boosting on the logistic loss over quantile cuts.

    With no rows, or with one class only, the model is a constant at the smoothed base rate.
    """
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if len(y) == 0 or y.min() == y.max():
        return Model(base, ())
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="higher")) for j in range(x.shape[1])]
    cuts = [np.unique(np.append(c, np.min(col[col > col.min()], initial=np.inf))) for c, col in zip(cuts, x.T, strict=True)]
    cuts = [c[np.isfinite(c)] for c in cuts]
    binned = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), base)
    grown = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        node = _grow(binned, p - y, p * (1 - p), np.arange(len(y)), cuts, depth, rate, ridge, least)
        _add(node, x, np.arange(len(y)), margin)
        grown.append(node)
    return Model(base, tuple(grown))


def _grow(
    b: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, cuts: list[np.ndarray], depth: int, rate: float, ridge: float, least: float
) -> Node:
    gs, hs = g[at].sum(), h[at].sum()
    leaf = Node(float(-rate * gs / (hs + ridge)))
    if depth == 0 or len(at) < 4:
        return leaf
    best, where = 1e-6, None
    for j, c in enumerate(cuts):
        if not len(c):
            continue
        gl = np.bincount(b[at, j], g[at], len(c) + 1).cumsum()[:-1]
        hl = np.bincount(b[at, j], h[at], len(c) + 1).cumsum()[:-1]
        n = np.bincount(b[at, j], minlength=len(c) + 1).cumsum()[:-1]
        gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
        gain[(n < least) | (len(at) - n < least)] = -np.inf
        k = int(gain.argmax())
        if gain[k] > best:
            best, where = float(gain[k]), (j, k)
    if where is None:
        return leaf
    j, k = where
    low = b[at, j] <= k
    rest = (cuts, depth - 1, rate, ridge, least)
    return Node(leaf.value, j, float(cuts[j][k]), _grow(b, g, h, at[low], *rest), _grow(b, g, h, at[~low], *rest))


@dataclass(frozen=True)
class Isotonic:
    """A non-decreasing map from margins to probabilities, linear between its knots."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.at, self.value)


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; each block is smoothed towards one half by one pseudo-row."""
    if len(y) == 0:
        return Isotonic(np.array([0.0]), np.array([0.5]))
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of margins
    for m, t in zip(margin[order], y[order], strict=True):
        blocks.append([float(t), 1.0, float(m)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, w = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + w]
    value = np.maximum.accumulate([(s + 0.5) / (n + 1) for s, n, _ in blocks])
    return Isotonic(np.array([w / n for _, n, w in blocks]), value)
