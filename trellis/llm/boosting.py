"""Gradient-boosted trees for two classes, in numpy, small enough to be printed as SQL.

Rows may carry weights, so that a table of distinct feature rows with counts trains the same model as the rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """A node: a leaf where ``feature`` is -1; else rows with value < cut go left."""

    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    left: Tree | None = None
    right: Tree | None = None

    def sql(self, names: list[str]) -> str:
        if self.feature < 0:
            return f"{self.value!r}D"
        return f"if({names[self.feature]} < {self.cut!r}D, {self.left.sql(names)}, {self.right.sql(names)})"

    def apply(self, x: np.ndarray, out: np.ndarray, rows: np.ndarray) -> None:
        if self.feature < 0:
            out[rows] += self.value
            return
        low = x[rows, self.feature] < self.cut
        self.left.apply(x, out, rows[low])
        self.right.apply(x, out, rows[~low])


@dataclass
class Boosted:
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in self.trees:
            t.apply(x, out, rows)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))

    def sql(self, names: list[str]) -> str:
        return f"1D / (1D + exp(-({' + '.join([f'{self.base!r}D', *(t.sql(names) for t in self.trees)])})))"


def _grow(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, rate: float, least: float) -> Tree:
    gs, hs = g[rows].sum(), h[rows].sum()
    leaf = Tree(value=float(rate * gs / (hs + 1.0)))
    if depth == 0 or len(rows) < 2:
        return leaf
    best, gain = None, 1e-6
    for f, c in enumerate(cuts):
        if not len(c):
            continue
        gb = np.bincount(bins[rows, f], g[rows], len(c) + 1).cumsum()[:-1]
        hb = np.bincount(bins[rows, f], h[rows], len(c) + 1).cumsum()[:-1]
        got = gb**2 / (hb + 1) + (gs - gb) ** 2 / (hs - hb + 1) - gs**2 / (hs + 1)
        got[(hb < least) | (hs - hb < least)] = 0
        k = int(got.argmax())
        if got[k] > gain:
            best, gain = (f, k), got[k]
    if best is None:
        return leaf
    f, k = best
    low = bins[rows, f] <= k
    return Tree(0.0, f, float(cuts[f][k]), _grow(x, bins, cuts, g, h, rows[low], depth - 1, rate, least), _grow(x, bins, cuts, g, h, rows[~low], depth - 1, rate, least))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 60, depth: int = 3, rate: float = 0.2, least: float = 1.0, bins: int = 32) -> Boosted:
    """Second-order boosting of the log loss over histograms. An empty or one-sided sample gives a constant."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    w = np.ones(len(y)) if weight is None else np.asarray(weight, float)
    total = w.sum()
    rate_1 = ((w * y).sum() + 0.5) / (total + 1.0)
    model = Boosted(base=float(np.log(rate_1 / (1 - rate_1))))
    if len(y) == 0 or y.min() == y.max():
        return model
    cuts = []
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        mids = (v[1:] + v[:-1]) / 2
        cuts.append(mids if len(mids) < bins else np.unique(np.quantile(mids, np.linspace(0, 1, bins))))
    place = np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)], axis=1)
    rows, m = np.arange(len(y)), np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-m))
        tree = _grow(x, place, cuts, w * (y - p), w * np.maximum(p * (1 - p), 1e-6), rows, depth, rate, least)
        tree.apply(x, m, rows)
        model.trees.append(tree)
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, rate) of a non-decreasing calibration, to be interpolated.

    Every block counts one more row of either class, so that no score becomes 0 or 1 for sure.
    """
    if not len(y):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], np.asarray(y, float)[order], strict=True):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
    knots = [(s, (b[0] + 0.5) / (b[1] + 1.0)) for b in blocks for s in (b[2], b[3])]
    at, rate = map(np.array, zip(*knots, strict=True))
    return at, np.maximum.accumulate(rate)
